import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import chat, url_tree, warc

REC = "record_id long, type string, url string, date timestamp, headers map<string,string>, payload string, status string"


def test_revisits(spark):
    from datetime import datetime, timedelta

    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    recs = [
        (1, "response", "http://www.A.org:80/x/?b=2&a=1&utm_source=f", t(0), {"ETag": '"v1"', "Content-Type": "text/html", "X": "old"}, "one", "z"),
        (2, "response", "https://a.org/x?a=1&b=2#top", t(2), {"ETag": '"v2"', "Last-Modified": "m"}, "two", None),
        (2, "response", "https://a.org/x?a=1&b=2#top", t(2), {"ETag": '"v2"', "Last-Modified": "m"}, "two", None),
        (10, "revisit", "a.org/x?a=1&b=2", t(1), {"etag": 'W/"v1"', "x": "new", "Content-Type": "no"}, None, None),
        (11, "revisit", "a.org/x?a=1&b=2", t(3), {"ETag": '"v1"'}, None, None),
        (12, "revisit", "a.org/x?a=1&b=2", t(3), {"Last-Modified": "m"}, None, None),
        (13, "revisit", "a.org/x?a=1&b=2", t(3), None, None, None),
        (14, "revisit", "a.org/x?a=1&b=2", t(0), {"ETag": '"v1"'}, None, None),
        (15, "revisit", None, t(3), {}, None, None),
        (16, "revisit", "a.org/x?a=1&b=2", None, {}, None, None),
        (None, "revisit", "a.org/x?a=1&b=2", t(1), {"ETag": '"v1"', "etag": '"v1"'}, None, None),
        (None, None, None, None, None, None, None),
    ]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(recs, REC)).collect()}
    assert {k: (r.status, r.source_id, r.payload) for k, r in got.items()} == {
        10: ("resolved", 1, "one"), None: ("resolved", 1, "one"), 11: ("mismatch", 2, None), 12: ("resolved", 2, "two"), 13: ("unverified", 2, None),
        14: ("orphan", None, None), 15: ("orphan", None, None), 16: ("orphan", None, None),
    }
    assert got[10].headers == {"etag": 'W/"v1"', "content-type": "text/html", "x": "new"}
    assert warc.resolve_revisits(spark.createDataFrame([], REC)).count() == 0


def test_revisits_long_empty_and_unused_payloads(spark):
    """Very long and empty payloads come through whole; responses without a revisit, and clashing columns, don't matter."""
    from datetime import datetime, timedelta

    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    long = "<p>" * 300_000
    recs = [(i, "response", f"h.org/{i}", t(0), {"ETag": f'"{i}"'}, long if i == 3 else "" if i == 4 else None if i == 5 else f"body {i}", "s", 1) for i in range(200)]
    recs += [(1000 + i, "revisit", f"h.org/{i}", t(1), {"ETag": f'"{i}"'}, None, None, 2) for i in range(3, 8)]
    out = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(recs, REC + ", source_key long")).collect()}
    assert {k: r.payload for k, r in out.items()} == {1003: long, 1004: "", 1005: None, 1006: "body 6", 1007: "body 7"}
    assert all(r.status == "resolved" and r.source_id == k - 1000 for k, r in out.items())


def test_templates_of_urls(spark):
    rows = [(i, f"https://h.org/{l}/{i * 17}", i % 10 > 0) for i, l in enumerate(["en", "fr", "de"] * 40)]
    rows += [(1000 + i, f"http://H.org/junk/buy-{i}.html?x={i}", False) for i in range(30)]
    rows += [(2000 + i, f"h.org/about/{w}", None) for i, w in enumerate(["us", "team", "us", "team"] * 5)]
    rows += [(3000, None, True), (3001, "", True), (3002, "h.org", True), (3003, "http://h.org/" + "d/" * 40, None), (None, "h.org/en/5", None), (3002, "h.org", True)]
    df = spark.createDataFrame(rows, "page_id long, url string, good_label boolean")
    out = url_tree.filter_urls(df, F.col("good_label"), max_depth=12).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert by[0].template == "/{de|en|fr}/{n}" and not by[0].rejected and by[0].purity > 0.7
    assert by[1000].template == "/junk/buy-{n}.html/?x" and by[1000].rejected
    assert by[3000].template is None and not by[3000].rejected and by[3001].host is None and by[3002].template == "/" and by[3003].template.endswith("/**")
    assert url_tree.filter_urls(df.limit(0), F.col("good_label")).count() == 0
    assert {r.purity for r in url_tree.filter_urls(df.filter("page_id < 100"), F.lit(None).cast("boolean")).collect()} == {1.0}


def test_frequent_sections_and_deep_paths(spark):
    names = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(100 * k + i, f"h.org/{name}/{1000 * k + i}", k > 0) for k, name in enumerate(names) for i in range(20)]
    rows += [(50_000 + i, f"d.org/{'d/' * 14}{'bad' if i % 2 else 'good'}/{i}", i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, good_label boolean")
    by = {r.page_id: r for r in url_tree.filter_urls(df, F.col("good_label"), max_depth=None).collect()}
    assert by[0].template == "/ak/{n}" and by[0].rejected
    assert all(not by[100 * k + i].rejected and by[100 * k + i].template != by[0].template for k in range(1, 100) for i in range(20))
    assert by[50_000].template == "/" + "d/" * 14 + "good/{n}" and not by[50_000].rejected
    assert by[50_001].template == "/" + "d/" * 14 + "bad/{n}" and by[50_001].rejected


def test_purity_brute(spark):
    rows = [(i, f"h.org/{'abc'[i % 3]}", [True, i % 2 == 0, None][i % 3]) for i in range(60)]
    out = url_tree.filter_urls(spark.createDataFrame(rows, "page_id long, url string, g boolean"), F.col("g"), max_distance=-9.0, max_z=-1.0).collect()
    share = (30 + 1) / (40 + 1)
    host = (30 + 8 * share) / (40 + 8)
    want = {"/a": (20 + 8 * host) / 28, "/b": (10 + 8 * host) / 28, "/c": host}
    assert all(abs(r.purity - want[r.template]) < 1e-6 for r in out)


def test_template_language():
    run = lambda s, **v: chat.compile_template(s)(**v)[0]
    assert run("a{{ 1 + 2 * 3 }}{# no #}b") == "a7b"
    assert run("{% for m in xs -%}  {{ loop.index }}{{ m }}{% if not loop.last %}, {% endif %}{%- endfor %}", xs=["x", "y"]) == "1x, 2y"
    assert run("{% if a.b[0] == 'z' and c is not defined %}yes{% elif true %}no{% endif %}", a={"b": ["z"]}) == "yes"
    assert run("{{ 'q' if x is none else x | upper }}{{ y | default('d') }}{{ xs[1:] | join('-') }}", x="s", xs=["a", "b", "c"]) == "Sdb-c"
    assert run("{% set n = xs | length %}{{ n // 2 }} {{ 'é' ~ n }} {{ -1 }} {{ 'b' in 'abc' }} {{ 'k' not in d }}", xs=[1, 2, 3], d={}) == "1 é3 -1 true true"
    assert chat.fold_block(chat.parse("a{{ 'b' ~ 'c' }}{% if 1 > 2 %}{{ x }}{% else %}d{% endif %}")) == [("text", "abcd")]
    text, spans = chat.compile_template("u{% generation %}héy{% endgeneration %}!")()
    assert text == "uhéy!" and spans == [(1, 4)]
    for bad in ("{{ __x }}", "{{ a.__class__ }}", "{% for x in y %}", "{{ f(1) }}", "{{ 1 | nope }}", "{{ 1 + }}", "{% endif %}", "{{ a b }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    for bad in ("{{ 'a' * 9 }}", "{{ 1 // 0 }}", "{{ 1 < 'a' }}", "{% for x in 'abc' %}{% endfor %}", "{{ raise_exception('no') }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)()
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{% for a in x %}{% for b in x %}{{ b }}{% endfor %}{% endfor %}", max_steps=50)(x=list(range(10)))


def test_template_sandbox():
    """Deep nesting is a TemplateError, and neither steps nor memory run away; long inputs are no reason to refuse."""
    for bad in ("{{ " + "(" * 3000 + "1" + ")" * 3000 + " }}", "{% if x %}" * 3000 + "{% endif %}" * 3000):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)()
    doubling = "{% set x = 'ab' %}" + "{% set x = x ~ x %}" * 40
    for bad in (doubling, "{% for m in xs %}{{ x }}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad, max_chars=10_000)(x="y" * 100, xs=list(range(1000)))
    with pytest.raises(chat.TemplateError):
        chat.compile_template(doubling)()
    long = ["word " * 200_000] * 3
    assert chat.compile_template("{% for m in xs %}{{ m | upper }}{{ m ~ m }}{% endfor %}")(xs=long)[0].startswith("WORD")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "yes", "k"), (1, 0, "user", "hi?", "k"), (2, 0, "assistant", None, None), (2, 0, "assistant", None, None), (None, 0, None, "x", None), (None, 1, None, "x", None), (3, None, "user", "", None), (4, 0, "user", "long " * 50_000, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, generation string")
    got = {r.conv_id: r for r in chat.render_conversations(df).collect()}
    assert got[1].text == "<|im_start|>user\nhi?<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert [got[1].text[g.start : g.end] for g in got[1].generation] == ["yes<|im_end|>"]
    assert chat.render_conversations(df).filter("conv_id IS NULL").count() == 2
    assert len(got[2].generation) == 2 and got[None].text == "<|im_start|>\nx<|im_end|>\n" and got[3].generation == [] and len(got[4].text) > 250_000
    failed = {r.conv_id: r for r in chat.render_conversations(df, "{% if messages[0].role != 'user' %}{{ raise_exception('order') }}{% endif %}ok").collect()}
    assert failed[2].error == "order" and failed[2].text is None and failed[1].text == "ok"
    assert chat.render_conversations(df.limit(0)).count() == 0


def test_pipeline_end_to_end(spark, tmp_path):
    """Each stage on what the one before kept: nothing clean lost, copies gone, every token packed once per use."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    copies = docs.filter("length(text) > 400").limit(5).select((F.col("doc_id") + 100_000).alias("doc_id"), F.concat(F.replace(F.col("text"), F.lit("\n"), F.lit(" \n")), F.lit(" ")).alias("text"), "lang", "source", "n_chars")
    odd = spark.createDataFrame([(200_000, None, None, None, None), (200_001, "", "en", "s", 0), (None, "lonely words without an id", "en", None, 1)], docs.schema)
    docs.unionAll(copies).unionAll(odd).write.parquet(str(tmp_path / "documents.parquet"))
    at, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"{k}"))
        before, at = at, spark.read.parquet(str(tmp_path / f"{k}"))
        ids = {r[0] for r in at.select("doc_id").distinct().collect()}
        if name == "ngram_jaccard":
            assert not ids & set(range(100_000, 100_100))
        if name == "mixing":
            assert ids == {r[0] for r in before.filter("trim(text) <> ''").select("doc_id").distinct().collect()}
        sizes.append(at.count())
    tokens = before.select(F.sum(F.regexp_count("text", F.lit("[^ \\t\\n\\r]+")))).first()[0]
    assert at.agg(F.sum("tokens")).first()[0] == tokens
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes[-1]
    spark.createDataFrame([], docs.schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
