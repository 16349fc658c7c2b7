import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from fieldloom.llm import hnsw, langid, line_dedup, mixing, ngram_jaccard, packing, perplexity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, drop string, `src.x` int"
#: Nulls in every column, empty, blank and very long texts, ties and repeated rows.
ODD = [(1, "a b c d e\nline of text here\n", "en", "s", 5, "x", 1), (1, "a b c d e\nline of text here\n", "en", "s", 5, "x", 1), (2, None, None, None, None, None, None), (None, "line of text here", "en", None, 3, None, 2), (3, "", "en", "s", 0, "", 3), (4, " \n\t ", "fr", "t", 4, "", 4), (5, "word " * 60_000, "fr", "t", 300_000, "", 5), (6, "a b c d e\nline of text here\n", "en", "s", 5, "x", 1), (7, "é", "fr", "t", 1, "", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "run",
    [
        lambda d: mixing.mix_sources(d, target_entropy=0.9),
        lambda d: line_dedup.dedup_lines(d),
        lambda d: ngram_jaccard.jaccard_join(d),
        lambda d: ngram_jaccard.jaccard_classes(d),
        lambda d: ngram_jaccard.drop_near_duplicates(d),
        lambda d: perplexity.perplexity_verdicts(d),
        lambda d: langid.identify(d),
        lambda d: langid.keep_identified(d),
        lambda d: packing.pack_documents(d),
    ],
)
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_odd(odd):
    out = Counter(rows(line_dedup.dedup_lines(odd).select("doc_id", "text", "drop")))
    # One row of document 1 has the first occurrences; its repeat and document 6 lose all and go.
    assert out[(1, "a b c d e\nline of text here\n", "x")] == 1
    assert (2, None, None) in out and (3, "", "") in out and (4, " \n\t ", "") in out
    assert out[(6, "a b c d e\nline of text here\n", "x")] == 0 and not any(r[0] is None for r in out)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_line_dedup_brute(spark, limit):
    rng = np.random.default_rng(0)
    lines = [f"line number {i} of some" for i in range(30)] + ["short", "", "ünïcödé línes here"]
    docs = [(i, "\n".join(lines[j] for j in rng.integers(0, len(lines), rng.integers(1, 6)))) for i in range(80)]
    seen, want = set(), []
    for i, t in docs:
        keep, lost = [], False
        for line in t.split("\n"):
            if len(line.encode()) >= 10 and line in seen:
                lost = True
                continue
            seen.add(line) if len(line.encode()) >= 10 else None
            keep.append(line)
        if not lost or "\n".join(keep).strip():
            want.append((i, "\n".join(keep)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(rows(line_dedup.dedup_lines(df, broadcast_bytes=limit))) == want


def grams(text):
    import re

    w = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def test_jaccard_brute(spark):
    rng = np.random.default_rng(1)
    base = [[f"w{x}" for x in rng.integers(0, 500, 60)] for _ in range(12)]
    docs = []
    for k in range(150):
        w = list(base[k % 12])
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(0, len(w)))] = f"n{rng.integers(0, 999)}"
        docs.append((k, " ".join(w)))
    docs += [(200, docs[0][1].upper() + "!"), (201, None), (202, ""), (203, "one two"), (204, "One, two")]
    got = {(a, b): j for a, b, j in rows(ngram_jaccard.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")))}
    first = {}
    for i, t in docs:
        if t and grams(t):
            first.setdefault(tuple(t.lower().replace("!", "").replace(",", "").split()), i)
    named = {i: grams(t) for i, t in docs if t and i in first.values()}
    want = {(a, b): len(named[a] & named[b]) / len(named[a] | named[b]) for a in named for b in named if a < b}
    want = {p: j for p, j in want.items() if j >= 0.6}
    mine = {p: j for p, j in got.items() if p[0] in named and p[1] in named}
    assert set(mine) <= set(want) and len(mine) >= 0.98 * len(want) and all(math.isclose(mine[p], want[p]) for p in mine)
    assert got[(0, 200)] == 1.0 and got[(203, 204)] == 1.0


def brute_classes(docs):
    """Class and links of each id, over all pairs of documents."""
    sets = {i: grams(t) for i, t in docs if t and grams(t)}
    near = {a: {b for b in sets if b != a and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6} for a in sets}
    out = {}
    for i, _ in docs:
        seen, todo = {i}, [i]
        while todo:
            for b in near.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[i] = (min(seen), len(near.get(i, ())))
    return out


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard_classes_brute(spark, block):
    """Groups of copies and of near copies, in one block and in many."""
    rng = np.random.default_rng(6)
    docs = []
    for k in range(9):
        base = [f"w{x}" for x in rng.integers(0, 900, 80)]
        for c in range(1 + 5 * k):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, 80))] = f"n{rng.integers(0, 9999)}"
            docs.append((int(rng.permutation(10_000)[0]) * 500 + len(docs), " ".join(w) + "!" * (c % 3)))
    docs += [(7, docs[-1][1]), (8, docs[-1][1].upper()), (9, None), (10, ""), (11, "one two"), (12, "One, two"), (13, ". ; ")]
    got = rows(ngram_jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string"), block=block))
    assert {i: (c, n) for i, c, n in got} == brute_classes(docs) and len(got) == len(docs)


def test_jaccard_ids_of_any_type_and_repeats(spark):
    base = " ".join(f"w{x}" for x in range(40))
    docs = [("b", base), ("a", base + " end"), ("c", base.upper()), ("c", base.upper()), ("z", "quite another text here"), (None, base), ("y", None)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    assert {i: (c, n) for i, c, n in rows(ngram_jaccard.jaccard_classes(df))} == {"a": ("a", 2), "b": ("a", 2), "c": ("a", 2), "z": ("z", 0), "y": ("y", 0)}
    assert {(a, b) for a, b, _ in rows(ngram_jaccard.jaccard_join(df))} == {("a", "b"), ("b", "c")}
    assert Counter(r[0] for r in rows(ngram_jaccard.drop_near_duplicates(df))) == {"a": 1, "z": 1, "y": 1, None: 1}
    two = spark.createDataFrame([(1, base), (1, "quite another text here"), (2, base), (3, "Quite another, text here")], "doc_id long, text string")
    assert {i: (c, n) for i, c, n in rows(ngram_jaccard.jaccard_classes(two))} == {1: (1, 2), 2: (1, 1), 3: (1, 1)}


def test_bands():
    assert ngram_jaccard.choose_bands(0.6, 0.995, 96) == (3, 22) and ngram_jaccard.choose_bands(0.05, 0.995, 96) == (1, 104)
    for threshold in (0.3, 0.6, 0.9):
        r, b = ngram_jaccard.choose_bands(threshold, 0.995, 96)
        assert 1 - (1 - threshold**r) ** b >= 0.995


def test_groups_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(100, 101, 1.0)], "doc_a long, doc_b long, jaccard double")
    got = dict(rows(ngram_jaccard.groups(pairs)))
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100


def test_near_duplicates_odd(odd):
    kept = Counter(r[0] for r in rows(ngram_jaccard.drop_near_duplicates(odd)))
    assert kept[1] == 1 and kept[6] == 0 and kept[2] == kept[3] == kept[4] == kept[5] == 1 and kept[None] == 1


def test_mixing_budget_and_cover(spark, odd):
    rng = np.random.default_rng(2)
    docs = [(i, "t " * int(rng.integers(1, 40)), "big" if i % 4 else "small") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    cover = mixing.mix_sources(df, target_entropy=0.99, max_repetition=2.0, budget="cover", block_tokens=300)
    times = Counter(r.doc_id for r in cover.collect())
    assert set(times) == set(range(400)) and max(times.values()) <= 2
    total = sum(len(t.split()) for _, t, _ in docs)
    out = mixing.mix_sources(df, target_entropy=0.99, budget="total", block_tokens=300).collect()
    assert 0 <= total - sum(r.tokens for r in out) < 2 * 40
    assert {r.doc_id for r in mixing.mix_sources(odd, budget="cover").collect()} == {1, None, 5, 6, 7}


def brute_perplexity(docs):
    """Modified Kneser-Ney of order 5 over characters, text-book recursion over dictionaries."""
    half = {i: xxhash.xxh64_intdigest(t.encode(), seed=42) for i, t, _ in docs}
    half = {i: (h if h < 1 << 63 else h - (1 << 64)) % 2 for i, h in half.items()}
    models = {}
    for lang in {l for _, _, l in docs}:
        chars = {c for _, t, l in docs if l == lang for c in t}
        for h in (0, 1):
            counts = [Counter() for _ in range(6)]
            for i, t, l in docs:
                if l == lang and half[i] == h:
                    p = "\1" * 4 + t
                    counts[5].update(p[k : k + 5] for k in range(len(t)))
            for k in (4, 3, 2, 1):
                counts[k].update(g[1:] for g in counts[k + 1])
            context = [defaultdict(Counter) for _ in range(6)]
            for k in range(1, 6):
                for g, c in counts[k].items():
                    context[k][g[:-1]][g] = c
            d = [None] + [perplexity.discounts(*[sum(c == x for c in counts[k].values()) for x in (1, 2, 3, 4)]) for k in range(1, 6)]
            models[lang, h] = (context, d, 1 / (len(chars) + 1))

    def prob(model, g):
        context, d, p = model
        for k in range(1, 6):
            own = context[k].get(g[5 - k : 4])
            if own:
                total = sum(own.values())
                off = lambda c: d[k][min(c, 3) - 1]
                c = own.get(g[5 - k :], 0)
                p = ((c - off(c) if c else 0) + sum(off(x) for x in own.values()) * p) / total
        return p

    out = {}
    for i, t, l in docs:
        m = models[l, 1 - half[i]] if models[l, 1 - half[i]][0][5] else models[l, half[i]]
        p = "\1" * 4 + t
        out[i] = -sum(math.log(prob(m, p[k : k + 5])) for k in range(len(t))) / len(t)
    return out


def test_perplexity_brute(spark):
    rng = np.random.default_rng(4)
    part = ["the", "and", "ing", "tion", "é", "日本", " ", ". ", "ou"]
    docs = [(i, "".join(part[k] for k in rng.integers(0, len(part), 40)), "en" if i % 3 else "fr") for i in range(30)] + [(90, "solo text", "xx")]
    want = brute_perplexity(docs)
    df = spark.createDataFrame([*docs, (91, None, "en"), (92, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in perplexity.perplexity_verdicts(df).collect()}
    assert all(math.isclose(got[i].log_perplexity, want[i], abs_tol=2e-6) for i in want)
    assert got[91].log_perplexity is None and not got[91].rejected and got[92].chars == 0
    joined = {r.doc_id: r.log_perplexity for r in perplexity.perplexity_verdicts(df, array_bytes=0).collect()}
    assert all(math.isclose(joined[i], want[i], abs_tol=2e-6) for i in want)


def test_perplexity_rejects_junk_keeps_clean(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(0)
    junk = [(10_000 + i, "".join(chr(c) for c in rng.integers(33, 126, 900)), "en") for i in range(3)] + [(10_010, "zq " * 400, "en")]
    got = {r.doc_id: r.rejected for r in perplexity.perplexity_verdicts(d.unionAll(spark.createDataFrame(junk, d.schema))).collect()}
    assert all(got[i] for i, _, _ in junk)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1 AND toxic = 0").collect()
    assert np.mean([not got[r.doc_id] for r in labels if r.doc_id in got]) > 0.97


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(d.filter("doc_id % 2 = 0"), per_language=100)
    out = langid.identify(d.filter("doc_id % 2 = 1"), model).select("lang", "language.*").collect()
    told = [r for r in out if r.predicted]
    assert np.mean([r.predicted == r.lang for r in told]) > 0.98 and np.mean([r.ambiguous for r in out]) < 0.02
    c = langid.codewords(9)
    assert min((c[i] != c[j]).sum() for i in range(9) for j in range(i)) >= 8


def test_language_odd(odd):
    out = {r.doc_id: r.language for r in langid.identify(odd).collect()}
    assert out[2].predicted is None and out[3].predicted is None and not out[3].ambiguous and out[7].predicted is None
    assert langid.keep_identified(odd).columns == odd.columns


def test_packing_optimal():
    def best(s, c):
        s, found = sorted(s, reverse=True), [len(s)]

        def go(i, bins):
            if len(bins) >= found[0]:
                return
            if i == len(s):
                found[0] = len(bins)
                return
            for room in set(bins):
                if room >= s[i]:
                    rest = list(bins)
                    rest.remove(room)
                    go(i + 1, [*rest, room - s[i]])
            go(i + 1, [*bins, c - s[i]])

        go(0, [])
        return found[0]

    rng = np.random.default_rng(0)
    for t in range(200):
        s = rng.integers(*((1, 21) if t % 2 else (4, 12)), int(rng.integers(1, 10))).tolist()
        bins = packing.pack(s, 20, 10**6)
        assert sorted(i for b in bins for i in b) == list(range(len(s))) and all(sum(s[i] for i in b) <= 20 for b in bins)
        assert len(bins) == best(s, 20)
    assert len(packing.pack([6, 6, 5, 5, 4, 4] * 9, 15, 0)) == len(packing.best_fit([6, 6, 5, 5, 4, 4] * 9, 15))


def test_packing_layout(spark, odd):
    rng = np.random.default_rng(1)
    docs = [(i, "x " * int(rng.integers(0, 90))) for i in range(300)]
    out = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), capacity=32, chunk=40, bucket_rows=100).collect()
    covered, windows = defaultdict(list), defaultdict(list)
    for r in out:
        covered[r.doc_id].append((r.start, r.start + r.tokens))
        windows[r.window].append((r.at, r.at + r.tokens))
    for i, t in docs:
        n, at = len(t.split()), 0
        for a, b in sorted(covered[i]):
            assert a == at
            at = b
        assert at == n and len(covered[i]) == -(-n // 32)
    for spans in windows.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 32 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert Counter(r.doc_id for r in packing.pack_documents(odd, capacity=100_000).collect()) == {1: 2, None: 1, 5: 1, 6: 1, 7: 1}


def test_packing_whole_stream(spark):
    docs = [(i, "x " * 5) for i in range(1600)]
    out = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), capacity=2048).collect()
    assert len({r.window for r in out}) == 4 and sum(r.tokens for r in out) == 8000


def test_hnsw_recall_and_odd(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(20, 24))[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 24)) * 0.5).astype(np.float32)
    x[10] = x[11] = x[12]
    bad = [(9001, None), (9002, []), (9003, [1.0, 2.0]), (9004, [float("nan")] * 24), (None, [0.0] * 24), (9005, [None] * 24)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad + [(0, x[0].tolist())], "vec_id long, embedding array<float>")
    out = hnsw.nearest_neighbours(df, k=10, shard_rows=800, block_rows=1000).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.vec_id, r.rank)):
        got[r.vec_id].append((r.neighbour, r.distance))
    assert set(got) == set(range(3000)) and all(len(v) == 10 and v == sorted(v, key=lambda p: (p[1], p[0])) for v in got.values())
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, 1, kind="stable")[:, :10]
    assert np.mean([len({n for n, _ in got[i]} & set(want[i].tolist())) / 10 for i in range(3000)]) >= 0.95
    assert {n for n, s in got[10] if s == 0} == {11, 12}
    assert hnsw.nearest_neighbours(df.filter("vec_id < 3"), k=10).count() == 6
    assert hnsw.nearest_neighbours(df.filter("vec_id = 1"), k=10).count() == 0
    assert hnsw.nearest_neighbours(df.limit(0), k=10).count() == 0


def brute_neighbours(ids, x, queries, k):
    d = {q: sorted((np.sqrt(((x[i].astype(float) - x[ids.index(q)].astype(float)) ** 2).sum()), ids[i]) for i in range(len(ids)) if ids[i] != q)[:k] for q in queries}
    return {q: [n for _, n in v] for q, v in d.items()}


def test_hnsw_copies_and_text_ids(spark):
    """Hundreds of equal vectors in a shard don't hide the others; ids may be texts, and clashing columns don't matter."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:500] = x[100]
    x[500:520] = x[500]
    ids = [f"v{i:04d}" for i in range(900)]
    df = spark.createDataFrame([(i, v.tolist(), 1, 2, 3) for i, v in zip(ids, x)], "vec_id string, embedding array<float>, shard int, x int, ids int")
    asked = [ids[i] for i in (0, 5, 100, 300, 499, 505, 700, 899)]
    got = defaultdict(list)
    for r in sorted(hnsw.nearest_neighbours(df, df.filter(df.vec_id.isin(asked)), k=10).collect(), key=lambda r: (r.vec_id, r.rank)):
        got[r.vec_id].append(r.neighbour)
    want = brute_neighbours(ids, x, asked, 10)
    assert set(got) == set(asked) and np.mean([len(set(got[q]) & set(want[q])) / 10 for q in asked]) >= 0.95
    assert got[ids[300]] == ids[100:110] and got[ids[100]] == ids[101:111] and got[ids[505]] == ids[500:505] + ids[506:511]


def test_hnsw_query_recall(spark):
    """The registered query on the largest table against brute force."""
    from fieldloom.llm import queries

    sf = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(t.embedding), t.vec_id.to_numpy()
    got = defaultdict(set)
    for r in queries.op10_hnsw(spark, sf).collect():
        got[r.vec_id].add(r.neighbour)
    hit = []
    for i in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hit.append(len(got[ids[i]] & set(ids[np.argsort(d)[:10]].tolist())) / 10)
    assert len(hit) == len(got) and np.mean(hit) >= 0.95
