"""Line deduplication with two Bloom filters.

One pass over the texts fills, for every partition of the input, a filter of the
line hashes that it saw once and one of those that it saw twice. Merged, a bit
that two partitions set in the first filter is set in the second one, so the
second holds every line that occurs twice anywhere. A second pass looks every
line up in it; only those suspected repeats are shuffled, grouped by their whole
text, and all but the first occurrence are taken out. A false positive of the
filter costs a little traffic and changes no result.

The hash space is cut into shards of a fixed number of bits, whose number follows
the number of lines. The merged filter is broadcast while it is within
``broadcast_bytes``; beyond that the second pass sends hashes and places of lines,
no text, to the filter's shards instead. In the end only documents that lose lines
meet the list of these by a join; a third filter, of their keys, lets all others
pass where they were read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from . import textvec as tv
from .common import col, cut, fresh

def _hashes(b: np.ndarray, o: np.ndarray, min_bytes: int):
    """Of the lines of at least ``min_bytes``: hash, document, number in it, start and end byte."""
    start, end, first = tv.lines(b, o)
    long = np.flatnonzero(end - start >= min_bytes)
    doc = np.repeat(np.arange(len(o) - 1), np.diff(first))[long]
    start, end = start[long], end[long]
    return tv.span_hash(tv.prefix_hash(b), start, end), doc, long - first[doc], start, end


def _batch_slices(column):
    b_all, o_all = tv.buffers(column)
    for i, j in tv.slices(o_all):
        yield i, b_all[o_all[i] : o_all[j]], o_all[i : j + 1] - o_all[i]


def _filler(shards: int, min_bytes: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [_hashes(b, o, min_bytes)[0] for batch in batches for _, b, o in _batch_slices(batch.column(0))]
        h, count = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, int))
        at = bloom.shard_of(h, shards)
        for s in np.unique(at):
            here = at == s
            once = np.unique(bloom.probes(h[here]))
            twice = np.unique(bloom.probes(h[here & (count > 1)]))
            yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int64()), pa.array([once.tobytes()], pa.binary()), pa.array([twice.tobytes()], pa.binary())], names=["shard", "once", "twice"])

    return fill


def _merge(parts: pa.Table) -> pa.Table:
    seen = np.zeros(bloom.SHARD_BITS, np.uint8)
    for once in parts.column("once"):
        at = np.frombuffer(once.as_buffer(), np.uint32)
        seen[at] = np.minimum(seen[at] + 1, 2)
    for twice in parts.column("twice"):
        seen[np.frombuffer(twice.as_buffer(), np.uint32)] = 2
    return pa.table({"shard": parts.column("shard").slice(0, 1), "bits": pa.array([bloom.freeze(seen == 2)], pa.binary())})


def twice_filter(texts: DataFrame, min_bytes: int) -> tuple[DataFrame, int]:
    """The filter of twice-seen lines as rows ``shard, bits``, and the number of shards."""
    newline = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    lines = texts.agg(F.sum(newline + 1)).first()[0] or 0
    shards = bloom.shards_for(lines)
    parts = texts.select("text").mapInArrow(_filler(shards, min_bytes), "shard long, once binary, twice binary")
    return cut(parts.groupBy("shard").applyInArrow(_merge, "shard long, bits binary")), shards


def _broadcast_prober(held, shards: int, min_bytes: int, with_text: bool):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.thaw(shards, held.value)
        for batch in batches:
            for i, b, o in _batch_slices(batch.column(3)):
                h, doc, number, start, end = _hashes(b, o, min_bytes)
                hit = np.flatnonzero(bloom.holds(h, bloom.shard_of(h, shards), bits))
                if not len(hit):
                    continue
                doc, number = doc[hit], number[hit]
                if with_text:
                    raw = b.tobytes()
                    text = [raw[s:e].decode("utf-8", "replace") for s, e in zip(start[hit], end[hit])]
                    keys = [batch.column(k).take(pa.array(doc + i)) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(number.astype(np.int32)), pa.array(text, pa.string())], names=["doc", "key_a", "key_b", "number", "line"])
                else:
                    own, at = np.unique(doc, return_index=True)
                    keys = [batch.column(k).take(pa.array(own + i)) for k in range(3)]
                    numbers = pa.ListArray.from_arrays(np.append(at, len(doc)).astype(np.int32), pa.array(number.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*keys, numbers], names=["doc", "key_a", "key_b", "numbers"])

    return probe


def _hash_lister(shards: int, min_bytes: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b, o in _batch_slices(batch.column(3)):
                h, doc, number, _, _ = _hashes(b, o, min_bytes)
                keys = [batch.column(k).take(pa.array(doc + i)) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bloom.shard_of(h, shards).astype(np.int64)), *keys, pa.array(number.astype(np.int32)), pa.array(h.view(np.int64))], names=["shard", "doc", "key_a", "key_b", "number", "h"]
                )

    return listed


def _shard_prober(left: pa.Table, right: pa.Table) -> pa.Table:
    bits = bloom.thaw(1, [(0, b.as_py()) for b in right.column("bits")])
    h = left.column("h").to_numpy().view(np.uint64)
    return left.filter(pa.array(bloom.holds(h, np.zeros(len(h), np.int64), bits))).select(["doc", "key_a", "key_b", "number"])


def dedup_lines(
    docs: DataFrame,
    min_bytes: int = 10,
    drop_emptied: bool = True,
    broadcast_bytes: int = 64 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """Keep only the first occurrence of each line of at least ``min_bytes`` bytes.

    Lines are split at newlines and compared exactly, over the whole table. The
    first occurrence is the one with the smallest id (null ids last), then the
    smallest key of the row's text, then the smallest line number. Shorter lines
    (and so empty ones) always stay. All columns pass through; ``counts`` names
    two more for a text's lines and those taken out.

    Ids are of any type that has an order. A document that loses lines and has
    nothing but white space left is dropped if ``drop_emptied``. Null texts stay
    null and empty ones empty. Of rows that repeat an id and text, the one with
    the smallest row hash has the first occurrences and the others lose all lines
    that repeat. An empty table gives an empty one.
    """
    ka, kb, name_drop, name_copies, name_rank, name_doc, name_lines, name_row = fresh(docs, "key_a", "key_b", "drop", "copies", "rank", "doc", "lines", "row")
    doc, text = col(docs, id_col), col(docs, text_col)
    keyed = [F.xxhash64(doc, text), F.hash(text, doc)]
    texts = docs.select(doc.alias("doc"), keyed[0].alias("key_a"), keyed[1].alias("key_b"), text.alias("text")).filter("text IS NOT NULL")

    kind = docs.select(doc).schema[0].dataType.simpleString()
    filters, shards = twice_filter(texts, min_bytes)
    size = filters.agg(F.count("*") * bloom.SHARD_BITS / 8).first()[0]
    if size <= broadcast_bytes:
        held = docs.sparkSession.sparkContext.broadcast([(r.shard, bytes(r.bits)) for r in filters.toLocalIterator()])
        suspects = texts.mapInArrow(_broadcast_prober(held, shards, min_bytes, True), f"doc {kind}, key_a long, key_b int, number int, line string")
        placed = texts.mapInArrow(_broadcast_prober(held, shards, min_bytes, False), f"doc {kind}, key_a long, key_b int, numbers array<int>")
    else:
        listed = texts.mapInArrow(_hash_lister(shards, min_bytes), f"shard long, doc {kind}, key_a long, key_b int, number int, h long")
        hits = listed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_shard_prober, f"doc {kind}, key_a long, key_b int, number int")
        hits = cut(hits)
        per = hits.groupBy("key_a", "key_b").agg(F.array_sort(F.collect_set("number")).alias("wanted"))
        placed = hits.groupBy("doc", "key_a", "key_b", "number").count().withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
        placed = placed.groupBy("doc", "key_a", "key_b", "copy").agg(F.array_sort(F.collect_list("number")).alias("numbers")).drop("copy")
        parts = texts.join(per, ["key_a", "key_b"]).select("doc", "key_a", "key_b", F.split("text", "\n").alias("parts"), F.explode("wanted").alias("number"))
        suspects = parts.select("doc", "key_a", "key_b", "number", F.col("parts")[F.col("number")].alias("line"))

    first = suspects.groupBy("line").agg(F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "key_a", "key_b", "number")).alias("first"))
    first = first.groupBy("first.key_a", "first.key_b").agg(F.collect_list("first.number").alias("kept"))
    plan = placed.groupBy("key_a", "key_b").agg(F.first("numbers").alias("numbers"), F.count("*").alias("copies")).join(first, ["key_a", "key_b"], "left")
    dropped = F.coalesce(F.array_except("numbers", "kept"), F.col("numbers"))
    plan = plan.select("key_a", "key_b", dropped.alias(name_drop), F.col("copies").alias(name_copies), F.col("numbers").alias(name_lines)).filter((F.size(name_drop) > 0) | (F.col(name_copies) > 1))
    plan = cut(plan.withColumnsRenamed({"key_a": ka, "key_b": kb}))
    count = plan.count()

    docs_keyed = docs.withColumn(ka, keyed[0]).withColumn(kb, keyed[1])
    loses = bloom.key_filter(plan.select(ka), count)
    joined = (docs_keyed.filter(loses(ka)) if loses else docs_keyed).join(plan, [ka, kb], "left")
    joined = joined.withColumn(name_row, F.xxhash64(*[col(docs, c) for c, t in docs.dtypes if "map" not in t]))
    joined = joined.withColumn(name_rank, F.row_number().over(Window.partitionBy(ka, kb).orderBy(name_row)))
    drop = F.when((F.col(name_copies) > 1) & (F.col(name_rank) > 1), F.col(name_lines)).otherwise(F.col(name_drop))
    joined = joined.withColumn(name_drop, drop)
    changed = F.size(F.coalesce(name_drop, F.array().cast("array<int>"))) > 0
    parts = F.split(col(joined, text_col), "\n")
    left = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains(F.col(name_drop), i)), "\n")
    out = joined.withColumn(name_doc, F.when(changed, left).otherwise(col(joined, text_col)))
    if drop_emptied:
        out = out.filter(~(changed & (F.length(F.trim(F.translate(name_doc, "\n\r\t", ""))) == 0)) | col(out, text_col).isNull())
    wanted = [F.col(name_doc).alias(c) if c == text_col else col(out, c).alias(c) for c in docs.columns]
    if counts:
        wanted += [F.size(parts).alias(counts[0]), F.when(changed, F.size(name_drop)).otherwise(0).alias(counts[1])]
    out = out.select(*wanted)
    if not loses:
        return out
    same = docs_keyed.filter(~loses(ka))
    wanted = [col(same, c).alias(c) for c in docs.columns]
    if counts:
        wanted += [F.size(F.split(col(same, text_col), "\n")).alias(counts[0]), F.lit(0).alias(counts[1])]
    return out.unionAll(same.select(*wanted))
