"""Operators that SQL can't express against plain Python versions, and the cases that every operator must bear."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import chat, langid, line_dedup, mixing, ngram_jaccard, packing, perplexity, textvec, url_tree

SF = "/root/testdata/sf0.001"


def plain_features(text):
    """Hashed n-gram counts, letter by letter."""
    letter = lambda c: "a" <= c <= "z" or (ord(c) >= 192 and c not in "×÷" and not 0x2000 <= ord(c) <= 0x2BFF and not 0x3000 <= ord(c) <= 0x303F)
    kept = []
    for c in text.lower():
        if letter(c):
            kept.append(c)
        elif not kept or kept[-1] != " ":
            kept.append(" ")
    codes, out = [ord(c) for c in kept], np.zeros(langid.DIMS)
    for k in langid.ORDERS:
        for i in range(len(codes) - k + 1):
            h = 0
            for c in reversed(codes[i : i + k]):
                h = (h * 0x9E3779B97F4A7C15 + c) % 2**64
            out[int(textvec.mix(np.array([(h + k) % 2**64], np.uint64))[0] >> np.uint64(52))] += 1
    out = np.sqrt(out)
    return out / max(np.linalg.norm(out), 1e-9), sum(map(letter, text.lower()))


def test_language_brute(spark):
    """Features one by one, leave-one-out by fitting again without the row, and decoding by sums of losses."""
    rng = np.random.default_rng(3)
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["groß", "über", "straße", "weiß"], "cc": ["ночь", "день", "снег", "вода"]}
    docs = [(i, " ".join(rng.choice(words[l], 12)) + "," * (i % 3), l) for i, l in enumerate(["aa", "bb", "cc"] * 8)]
    docs += [(90, "lorem groß ночь", None), (91, None, "aa"), (92, "", "bb"), (93, "12 34", "cc"), (94, docs[0][1], "aa"), (94, docs[0][1], "aa"), (95, "snow " * 40_000, None)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, language string")
    model = langid.fit(df)
    x = np.array([plain_features(t)[0] for _, t, l in docs if l and t and plain_features(t)[1]])
    langs = [l for _, t, l in docs if l and t and plain_features(t)[1]]
    x = x.astype(np.float16).astype(float)
    y = model.code[[model.names.index(l) for l in langs]]
    gram = x @ x.T
    matrix = x.T @ np.linalg.solve(gram + 0.1 * np.eye(len(x)), y)
    assert model.names == ["aa", "bb", "cc"] and np.allclose(model.matrix, matrix, atol=1e-3)
    right = np.zeros(y.shape[1])
    for i in range(len(x)):
        rest = [j for j in range(len(x)) if j != i]
        w = np.linalg.solve(gram[np.ix_(rest, rest)] + 0.1 * np.eye(len(rest)), y[rest])
        right += np.sign(gram[i, rest] @ w) == y[i]
    bits = np.maximum(right / len(x) - 0.5, 0)
    assert np.allclose(model.bits, bits / bits.sum(), atol=1e-6)
    out = langid.identify(df, model)
    assert "_language" in out.columns and out.count() == len(docs)
    for r in out.collect():
        v, letters = plain_features(r.text or "")
        if letters < 12:
            assert r._language.predicted is None and not r._language.ambiguous
            continue
        margins = v @ model.matrix
        loss = [sum(b * max(0, 1 - m * c) ** 2 for m, c, b in zip(margins, code, model.bits)) for code in model.code]
        order = sorted(loss)
        assert r._language.predicted == model.names[int(np.argmin(loss))] and math.isclose(r._language.loss, order[0], abs_tol=1e-3)
        assert r._language.ambiguous == (order[1] - order[0] < model.min_margin or order[0] > model.far)
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {i for i, _, l in docs if l}


def test_perplexity_verdicts_brute(spark):
    """Bands and verdicts from the perplexities, by medians of plain lists; repeated rows, ties and clashing columns among them."""
    rng = np.random.default_rng(9)
    part = ["the ", "and ", "ing ", "of ", "was ", "in "]
    docs = [(i, "".join(part[k] for k in rng.integers(0, 6, int(rng.integers(20, 90)))), "en") for i in range(60)]
    docs += [(100, "zqx#" * 50, "en"), (100, "zqx#" * 50, "en"), (101, "the " * 30_000, "en"), (102, docs[0][1], "en"), (103, "lone", None)]
    df = spark.createDataFrame([(*d, 1, 2, "k") for d in docs], "doc_id long, text string, lang string, total int, half int, `key` string")
    out = perplexity.perplexity_verdicts(df, width=3.0).collect()
    assert len(out) == len(docs)
    for lang in ("en", None):
        own = [r for r in out if r.lang == lang]
        bins = sorted(round(r.log_perplexity * 1000) for r in own)
        middle = lambda v: sorted(v)[(len(v) + 1) // 2 - 1]
        mid = middle(bins)
        low, high = middle([mid - b for b in bins if b <= mid]), middle([b - mid for b in bins if b >= mid])
        for r in own:
            wide = math.sqrt(1 + 400 / r.chars) * 3.0
            lower, upper = mid / 1000 - wide * max(low * 1.4826 / 1000, 0.05), mid / 1000 + wide * max(high * 1.4826 / 1000, 0.05)
            assert math.isclose(r.lower, lower, abs_tol=2e-6) and math.isclose(r.upper, upper, abs_tol=2e-6)
            assert r.rejected == (r.log_perplexity < r.lower or r.log_perplexity > r.upper)
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert len(by[100]) == 2 and by[100][0] == by[100][1] and by[100][0].rejected and by[102][0].log_perplexity == by[0][0].log_perplexity
    rounds = sorted(tuple(r) for r in perplexity.perplexity_verdicts(df, width=3.0, array_bytes=4000).collect() if r.lang)
    assert all(a[:3] == b[:3] and all(math.isclose(u, v, abs_tol=2e-6) for u, v in zip(a[3:6], b[3:6])) for a, b in zip(rounds, sorted(tuple(r) for r in out if r.lang)))


def plain_templates(urls):
    """Generalised segments of each URL, level by level over dictionaries."""
    import re

    def shape(s):
        if re.fullmatch("[0-9a-fA-F-]{8,}", s) and re.search("[0-9]", s) and re.search("[a-fA-F]", s):
            return "{hex}"
        return re.sub("[0-9]+", "{n}", s) if re.search("[0-9]", s) else "*"

    rows = [(u.split("/")[0], [s for s in u.split("/")[1:] if s]) for u in urls]
    done = [[] for _ in rows]
    for level in range(max(len(s) for _, s in rows)):
        seen = defaultdict(Counter)
        for (host, segments), d in zip(rows, done):
            if len(segments) > level:
                seen[host, tuple(d), shape(segments[level])][segments[level]] += 1
        for (host, segments), d in zip(rows, done):
            if len(segments) > level:
                kind = shape(segments[level])
                own = seen[host, tuple(d), kind]
                wild = len(own) >= (8 if kind == "*" else 3) and len(own) >= 0.3 * sum(own.values())
                d.append(kind if wild else segments[level])
    return ["/" + "/".join(d) for d in done]


def test_templates_brute(spark):
    rng = np.random.default_rng(5)
    urls = []
    for _ in range(600):
        host = ["a.org", "b.org"][int(rng.integers(0, 2))]
        tail = [f"p{rng.integers(0, 400)}", f"{rng.integers(0, 99999):08x}", ["red", "blue"][int(rng.integers(0, 2))], f"w{'abcdefghijklmnop'[int(rng.integers(0, 16))]}x"][int(rng.integers(0, 4))]
        urls.append(f"{host}/{['x', 'y', 'z'][int(rng.integers(0, 3))]}/{tail}" + ("/end" if rng.integers(0, 2) else ""))
    urls.append("a.org/" + "s" * 100_000)
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, g boolean")
    got = {r.page_id: r.template for r in url_tree.filter_urls(df, F.col("g"), max_distance=-9.0).collect()}
    want = plain_templates(urls)
    assert all(got[i] == want[i] for i in range(len(urls)))


def test_merging_of_branches():
    """The greedy merge of siblings, on branches whose likeness is plain: same subtrees join, other subtrees or labels don't."""
    same = [((s, "{n}"), 500, 0, 0) for s in "abc"] + [(("d", "x"), 500, 0, 0), (("e", "y"), 400, 0, 0)]
    assert url_tree.merge_host(same, 0.15, 2.0) == [("{a|b|c}", "{n}")] * 3 + [("d", "x"), ("e", "y")]
    labels = [(("a", "{n}"), 500, 100, 95), (("b", "{n}"), 500, 100, 93), (("c", "{n}"), 500, 100, 20)]
    assert url_tree.merge_host(labels, 0.15, 2.0) == [("{a|b}", "{n}"), ("{a|b}", "{n}"), ("c", "{n}")]


def test_pipeline_stages_brute(spark, tmp_path):
    """Language, near duplicates, cover mixing and packing of the pipeline on rows of the fixture, each against a plain version."""
    from tests.llm.test_text_operators import brute_classes

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 4000")
    stage = dict(corpus_pipeline.STAGES)
    judged = {r.doc_id: r.language.ambiguous for r in langid.identify(docs).collect()}
    kept = stage["language_id"](spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {i for i, a in judged.items() if not a} and kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    classes = brute_classes(rows)
    left = {r.doc_id for r in stage["ngram_jaccard"](spark, docs, SF).select("doc_id").collect()}
    assert left == {i for i, (c, _) in classes.items() if c == i}
    mixed = Counter(r.doc_id for r in stage["mixing"](spark, docs, SF).select("doc_id").collect())
    tokens = {r.doc_id: (r.source, len([w for w in (r.text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w])) for r in docs.collect()}
    totals = Counter()
    for s, n in tokens.values():
        totals[s] += n
    vector = np.array(sorted(totals.values()), float)
    a = mixing.find_exponent(vector, 0.98, 2.0, None)
    share = {s: t**a for s, t in totals.items()}
    weight = {s: v / sum(share.values()) for s, v in share.items()}
    budget = max(totals[s] / weight[s] for s in totals)
    used = Counter()
    for i, k in mixed.items():
        used[tokens[i][0]] += k * tokens[i][1]
    most = max(n for _, n in tokens.values())
    assert set(mixed) == {i for i, (_, n) in tokens.items() if n}
    assert all(0 <= weight[s] * budget - used[s] + 1e-3 and weight[s] * budget - used[s] < most + 1 for s in totals)
    spans = defaultdict(list)
    for r in stage["best_fit_packing"](spark, docs, SF).collect():
        spans[r.doc_id].append((r.start, r.tokens))
    assert {i: sum(n for _, n in v) for i, v in spans.items()} == {i: n for i, (_, n) in tokens.items() if n}


CLASH = "id string, text string, lang string, source string, `doc` int, node int, bands int, `key_a` int, drop int, epoch int, src int, total int, window int, `a.b` int"
ROWS = [("x", "first line of a text\nshared line here\n", "en", "s", 1, 1, 1, 1, 1, 1, 1, 1, 1, 1), ("y", "shared line here\nand another one", "en", None, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1), ("y", "shared line here\nand another one", "en", None, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2), (None, None, None, None, *[None] * 10), ("z", "long " * 30_000, "fr", "s", *[0] * 10)]


@pytest.mark.parametrize(
    "run",
    [
        lambda d: mixing.mix_sources(d, id_col="id"),
        lambda d: line_dedup.dedup_lines(d, id_col="id"),
        lambda d: ngram_jaccard.drop_near_duplicates(d, id_col="id"),
        lambda d: ngram_jaccard.jaccard_classes(d, id_col="id"),
        lambda d: perplexity.perplexity_verdicts(d, id_col="id"),
        lambda d: langid.identify(d, id_col="id"),
        lambda d: packing.pack_documents(d, id_col="id"),
        lambda d: chat.render_conversations(d.withColumn("doc", F.col("doc").cast("long")), id_col="id", turn_col="doc", role_col="lang"),
        lambda d: url_tree.filter_urls(d, F.lit(None).cast("boolean"), id_col="id", url_col="text"),
    ],
)
def test_text_ids_clashing_columns_and_empty(spark, run):
    df = spark.createDataFrame(ROWS, CLASH)
    assert run(df).count() > 0
    assert run(df.limit(0)).count() == 0
    assert run(df.repartition(3)).count() == run(df).count()


def test_ids_with_dots(spark):
    df = spark.createDataFrame([(i, "some words in a line here\nand more " + str(i), "s") for i in range(20)], "`doc.id` long, `the.text` string, `its.source` string")
    names = {"id_col": "doc.id", "text_col": "the.text"}
    assert mixing.mix_sources(df, source_col="its.source", **names).count() == 20
    assert line_dedup.dedup_lines(df, **names).count() == 20
    assert ngram_jaccard.jaccard_classes(df, **names).count() == 20
    assert packing.pack_documents(df, **names).count() == 20


def test_repeated_rows_have_a_defined_result(spark):
    """Of rows that repeat id and text the one with the smallest row hash keeps its lines, however rows are partitioned."""
    rows = [(1, "a line that repeats\nand another line", "s", k) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, k int")
    for op in (line_dedup.dedup_lines, ngram_jaccard.drop_near_duplicates):
        assert {tuple(sorted(r.k for r in op(df.repartition(p)).collect())) for p in (1, 3, 5)}.__len__() == 1
