"""The operators' queries, with production parameters over whole tables, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .chat import render_conversations
from .common import table
from .hnsw import nearest_neighbours
from .langid import identify
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .ngram_jaccard import jaccard_classes
from .packing import pack_documents
from .perplexity import perplexity_verdicts
from .url_tree import filter_urls
from .warc import crawl_log, resolve_revisits

TARGET_ENTROPY, MAX_REPETITION, BLOCK_TOKENS, SEED = 0.98, 4.0, 100_000, 17


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), target_entropy=TARGET_ENTROPY, max_repetition=MAX_REPETITION, budget="total", block_tokens=BLOCK_TOKENS, seed=SEED)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), min_bytes=10)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), threshold=0.6, n=3)


def op4_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_verdicts(table(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers come as the lines of a header block."""
    found = resolve_revisits(crawl_log(table(spark, sf_dir, "pages")))
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.withColumn("headers", F.array_join(F.array_sort(lines), "\n"))


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is good if the document of its number is labelled to be of good quality."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 1).alias("good"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url").join(labels, "page_id", "left")
    return filter_urls(pages, F.col("good"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ChatML text; generation comes as ``start-end`` ranges with commas."""
    done = render_conversations(table(spark, sf_dir, "conversations"))
    ranges = F.transform("generation", lambda g: F.concat(g["start"].cast("string"), F.lit("-"), g["end"].cast("string")))
    return done.withColumn("generation", F.array_join(ranges, ","))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "lang", "language.*")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=2048)


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100; all rows are indexed."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_perplexity": op4_perplexity,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_url_templates": op6_url_templates,
    "op7_chat_format": op7_chat_format,
    "op8_language_id": op8_language_id,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_hnsw": op10_hnsw,
}

_NL = "chr(10)"

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": rf"""
WITH RECURSIVE tok AS (
    SELECT *, CAST(len(regexp_extract_all(text, '[^ \t\n\r]+')) AS BIGINT) AS tokens FROM documents
), doc AS (SELECT * FROM tok WHERE tokens > 0),
tot AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS total FROM doc GROUP BY source),
vec AS (SELECT list(CAST(total AS DOUBLE) ORDER BY total) AS t, sum(total)::DOUBLE AS budget, ln(max(total)) AS top FROM tot),
by_entropy(step, lo, hi) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
    UNION ALL
    SELECT step + 1, CASE WHEN low THEN (lo + hi) / 2 ELSE lo END, CASE WHEN low THEN hi ELSE (lo + hi) / 2 END
    FROM (SELECT step, lo, hi,
            ln(list_sum(list_transform(t, lambda x: exp((lo + hi) / 2 * (ln(x) - top)))))
            - list_sum(list_transform(t, lambda x: exp((lo + hi) / 2 * (ln(x) - top)) * (lo + hi) / 2 * (ln(x) - top)))
              / list_sum(list_transform(t, lambda x: exp((lo + hi) / 2 * (ln(x) - top)))) > {TARGET_ENTROPY} * ln(len(t)) AS low
          FROM by_entropy, vec WHERE step < 60)
), by_repetition(step, lo, hi) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
    UNION ALL
    SELECT step + 1, CASE WHEN low THEN (lo + hi) / 2 ELSE lo END, CASE WHEN low THEN hi ELSE (lo + hi) / 2 END
    FROM (SELECT step, lo, hi,
            list_max(list_transform(t, lambda x: exp((lo + hi) / 2 * (ln(x) - top)) / x)) * budget
            / list_sum(list_transform(t, lambda x: exp((lo + hi) / 2 * (ln(x) - top)))) > {MAX_REPETITION} AS low
          FROM by_repetition, vec WHERE step < 60)
), exponent AS (
    SELECT CASE WHEN len(t) < 2 THEN 1.0 ELSE round(greatest(
        (SELECT hi FROM by_entropy WHERE step = 60),
        CASE WHEN list_max(list_transform(t, lambda x: 1 / x)) * budget / len(t) > {MAX_REPETITION} THEN (SELECT hi FROM by_repetition WHERE step = 60) ELSE 0 END), 9) END AS a,
        t, budget, top FROM vec
), share AS (
    SELECT source, total, CAST(floor(exp((ln(total) - top) * a) / list_sum(list_transform(t, lambda x: exp((ln(x) - top) * a))) * budget + 1e-6) AS BIGINT) AS budget
    FROM tot, exponent
), blocked AS (
    SELECT d.*, s.total, s.budget,
        ('0x' || substr(md5(concat_ws(':', '{SEED}', 'block', coalesce(d.doc_id::VARCHAR, '\N'))), 1, 7))::BIGINT % CAST(greatest(1, ceil(s.total / {BLOCK_TOKENS}.0)) AS BIGINT) AS block
    FROM doc d JOIN share s ON d.source IS NOT DISTINCT FROM s.source
), blocks AS (
    SELECT source, block, total, budget, CAST(sum(tokens) AS BIGINT) AS block_total FROM blocked GROUP BY ALL
), epochs AS (
    SELECT *, unnest(range(0, CAST(floor((budget - 1e-9) / total) AS BIGINT) + 1)) AS epoch FROM blocks WHERE budget > 0
), plan AS (
    SELECT source, block, epoch, budget, block_total, epoch * total + coalesce(sum(block_total) OVER (
        PARTITION BY source, epoch
        ORDER BY ('0x' || substr(md5(concat_ws(':', '{SEED}', epoch::VARCHAR, block::VARCHAR)), 1, 7))::BIGINT, block
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM epochs
), used AS (
    SELECT b.*, p.epoch, p.start, p.block_total, sum(b.tokens) OVER (
        PARTITION BY b.source, p.epoch, b.block
        ORDER BY ('0x' || substr(md5(concat_ws(':', '{SEED}', p.epoch::VARCHAR, coalesce(b.doc_id::VARCHAR, '\N'))), 1, 7))::BIGINT, b.doc_id, b.tokens, b.text
        ROWS UNBOUNDED PRECEDING) AS cum
    FROM blocked b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source AND b.block = p.block WHERE p.start < p.budget
)
SELECT doc_id, text, lang, source, n_chars, CAST(epoch AS INTEGER) AS epoch, block, round(start::DOUBLE / budget, 9) AS slot, tokens
FROM used WHERE budget - start >= block_total OR cum <= budget - start
""",
    "op2_line_dedup": f"""
WITH line AS (
    SELECT doc_id, unnest(string_split(text, {_NL})) AS line, generate_subscripts(string_split(text, {_NL}), 1) AS i FROM documents WHERE text IS NOT NULL
), seen AS (
    SELECT *, strlen(line) >= 10 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS gone FROM line
), kept AS (
    SELECT doc_id, count(*) FILTER (gone) AS removed, coalesce(string_agg(line, {_NL} ORDER BY i) FILTER (NOT gone), '') AS text FROM seen GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text, d.lang, d.source, d.n_chars
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
WHERE d.text IS NULL OR removed = 0 OR trim(replace(replace(replace(k.text, {_NL}, ''), chr(13), ''), chr(9), '')) <> ''
""",
    "op3_ngram_jaccard": r"""
WITH RECURSIVE word AS (
    SELECT doc_id, regexp_extract_all(lower(text), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL
), node AS (SELECT min(doc_id) AS d, w, count(*) AS copies FROM word WHERE len(w) > 0 GROUP BY w),
gram AS (
    SELECT DISTINCT d, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM node
), size AS (SELECT d, count(*) AS n FROM gram GROUP BY d),
both_ AS (SELECT a.d AS a, b.d AS b, count(*) AS k FROM gram a JOIN gram b ON a.g = b.g AND a.d <> b.d GROUP BY a.d, b.d),
near AS (SELECT a, b FROM both_ JOIN size x ON x.d = a JOIN size y ON y.d = b WHERE k / (x.n + y.n - k) >= 0.6),
reach AS (SELECT d, d AS r FROM node UNION SELECT reach.d, near.b FROM reach JOIN near ON near.a = reach.r),
class AS (SELECT d, min(r) AS class_id FROM reach GROUP BY d),
links AS (SELECT a AS d, sum(o.copies) AS n FROM near JOIN node o ON o.d = near.b GROUP BY a)
SELECT word.doc_id, coalesce(class.class_id, word.doc_id) AS class_id, CAST(coalesce(node.copies - 1 + coalesce(links.n, 0), 0) AS BIGINT) AS links
FROM word LEFT JOIN node ON word.w = node.w LEFT JOIN class ON class.d = node.d LEFT JOIN links ON links.d = node.d
""",
    "op5_warc_revisits": r"""
WITH rec AS (
    SELECT page_id * 2 AS record_id, 'response' AS type, url, to_timestamp(1704067200 + page_id * 60) AS date, page_id AS n, html FROM pages
    UNION ALL
    SELECT page_id * 2 + 1, 'revisit', url || '#again', to_timestamp(1704067200 + 86400 + page_id * 60), page_id, html FROM pages
), bare AS (
    SELECT *, regexp_replace(regexp_replace(trim(url), '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM rec
), part AS (
    SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*[.]', '') AS host,
        regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '(?s)[?](.*)$', 1), '&'),
            lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|ref|gclid|fbclid|sessionid|phpsessid|jsessionid)(=|$)'))), '&') AS query
    FROM bare
), canon AS (
    SELECT record_id, type, date, n, html, CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS url,
        '"' || substr(md5(html), 1, 12) || '"' AS etag, strftime(to_timestamp(1704067200 + n * 60) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS modified FROM part
), pair AS (
    SELECT v.record_id, v.url AS canonical_url, v.n, v.etag AS own_tag, v.modified AS own_modified,
        r.record_id AS source_id, r.etag, r.modified, r.html, row_number() OVER (PARTITION BY v.record_id ORDER BY r.date DESC, r.record_id DESC) AS k
    FROM canon v LEFT JOIN canon r ON r.type = 'response' AND r.url = v.url AND r.date < v.date WHERE v.type = 'revisit'
), judged AS (
    SELECT *, CASE WHEN source_id IS NULL THEN 'orphan'
        WHEN n % 5 <> 0 THEN CASE WHEN own_tag = etag THEN 'resolved' ELSE 'mismatch' END
        WHEN own_modified = modified THEN 'resolved' ELSE 'mismatch' END AS status FROM pair WHERE k = 1
)
SELECT record_id, canonical_url, source_id, status,
    CASE WHEN status = 'resolved'
        THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || strlen(html) || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || CASE WHEN n % 3 = 0 AND n % 5 <> 0 THEN 'W/' ELSE '' END || etag || chr(10) || 'last-modified: ' || own_modified
        ELSE 'cache-control: max-age=600' || chr(10) || 'content-length: 0' || CASE WHEN n % 5 <> 0 THEN chr(10) || 'etag: ' || CASE WHEN n % 3 = 0 THEN 'W/' ELSE '' END || own_tag ELSE '' END || chr(10) || 'last-modified: ' || own_modified END AS headers,
    CASE WHEN status = 'resolved' THEN html END AS payload
FROM judged
""",
    "op7_chat_format": """
WITH turns AS (
    SELECT conv_id, role, row_number() OVER w AS k, length('<|im_start|>' || coalesce(role, '') || chr(10)) AS head,
        coalesce(text, '') || '<|im_end|>' AS body, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS whole
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), placed AS (
    SELECT *, coalesce(sum(length(whole)) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head AS pos FROM turns
)
SELECT conv_id, string_agg(whole, '' ORDER BY k) AS text,
    coalesce(string_agg(CAST(CAST(pos AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (role = 'assistant'), '') AS generation,
    CAST(NULL AS VARCHAR) AS error
FROM placed GROUP BY conv_id
""",
}
