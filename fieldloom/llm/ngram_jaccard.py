"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Texts are lower-cased and cut into words (letters, digits, non-ASCII
characters). Documents with the same word sequence are one node and are joined
without any search. Nodes that share a band of MinHash values are candidates; a
node goes to the place of the smallest node in any of its buckets, and a place
with many nodes or n-grams is cut into blocks. Two places that meet in a bucket
(or a place with itself) are a unit of work: the n-gram sets of its nodes are
intersected all at once, as products of 0/1 matrices. No candidate pair is ever
written, no bucket is cut short, and a hot bucket is many units of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import col, cut, fresh, maybe_broadcast

_SEQ_SALT = np.uint64(0x5851F42D4C957F2D)
_COLUMNS = 4096


def choose_bands(threshold: float, target_recall: float, max_hashes: int) -> tuple[int, int]:
    """Rows per band and bands: the most selective rows that reach the recall at the threshold.

    ``max_hashes`` is what a document may cost; where even one row a band needs
    more to reach the recall, one row a band is taken and the hashes it needs.
    """
    best = None
    for rows in range(1, 17):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - target_recall) / math.log1p(-p))
        if best is None or rows * bands <= max_hashes:
            best = (rows, bands)
    return best


def _sequence(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each document's word sequence; 0 for one without words."""
    count = np.diff(first)
    out = np.zeros(len(count), np.uint64)
    has = np.flatnonzero(count)
    if len(has):
        at = (np.arange(len(h)) - np.repeat(first[:-1], count)).astype(np.uint64)
        out[has] = tv.mix(np.add.reduceat(h * (tv.mix(at + _SEQ_SALT) | np.uint64(1)), first[:-1][has]))
    return out


def _signer(n: int, rows: int, bands: int, seed: int):
    mult = np.random.default_rng(seed).integers(1, 2**32, rows * bands, dtype=np.uint64).astype(np.uint32) | np.uint32(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b_all, o_all = tv.buffers(pc.utf8_lower(batch.column(1)))
            for i, j in tv.slices(o_all):
                b, o = b_all[o_all[i] : o_all[j]], o_all[i : j + 1] - o_all[i]
                h, _, first = tv.words(b, o)
                grams, at = tv.ngrams(h, first, n)
                size = np.diff(at)
                has = np.flatnonzero(size)
                x = (grams >> np.uint64(32)).astype(np.uint32)
                starts = at[:-1][has]
                keys = np.empty((len(has), bands), np.uint64)
                for k in range(bands):
                    acc = np.full(len(has), k + 1, np.uint64)
                    for r in range(rows):
                        least = np.minimum.reduceat(x * mult[k * rows + r], starts) if len(has) else x[:0]
                        acc = tv.mix(acc + least.astype(np.uint64))
                    keys[:, k] = acc
                at = np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(_sequence(h, first).view(np.int64), mask=size == 0),
                        pa.array(size.astype(np.int64)),
                        pa.ListArray.from_arrays(at, pa.array(keys.view(np.int64).ravel())),
                    ],
                    names=["doc", "node", "size", "bands"],
                )

    return sign


def _setter(n: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b_all, o_all = tv.buffers(pc.utf8_lower(batch.column(1)))
            for i, j in tv.slices(o_all):
                b, o = b_all[o_all[i] : o_all[j]], o_all[i : j + 1] - o_all[i]
                h, _, first = tv.words(b, o)
                seq = _sequence(h, first).view(np.int64)
                grams, at = tv.ngrams(h, first, n)
                want = batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)
                keep = np.flatnonzero(seq == want)
                sets = [np.unique(grams[at[d] : at[d + 1]]).tobytes() for d in keep]
                yield pa.RecordBatch.from_arrays([pa.array(want[keep]), pa.array(sets, pa.binary())], names=["node", "grams"])

    return make


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with all.

    An n-gram that is in few of the sets adds one to each of its pairs; the others
    are columns of a 0/1 matrix, which is multiplied with itself.
    """
    n = len(sets)
    out = np.zeros((n, n))
    grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(grams, kind="stable")
    grams, row = grams[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, int)
    count = np.diff(np.append(first, len(grams)))
    few = []
    for c in range(2, 8):
        some = first[count == c]
        few += [row[some + i] * n + row[some + j] for i in range(c) for j in range(i)]
    out += np.bincount(np.concatenate(few), minlength=n * n).reshape(n, n)
    out += out.T.copy()
    often = np.flatnonzero(count >= 8)
    for s in range(0, len(often), _COLUMNS):
        some = often[s : s + _COLUMNS]
        x = np.zeros((n, len(some)), np.float32)
        at = np.repeat(first[some] - np.concatenate(([0], np.cumsum(count[some])[:-1])), count[some]) + np.arange(count[some].sum())
        x[row[at], np.repeat(np.arange(len(some)), count[some])] = 1
        out += x @ x.T
    return out


def _similar(nodes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Jaccard index of the pairs of a unit that reach the threshold, 0 for others; in a unit of two places only pairs across."""
    size = np.array([len(x) for x in sets], float)
    both = _common(sets)
    jaccard = both / np.maximum(size[:, None] + size[None] - both, 1)
    ok = jaccard >= threshold
    np.fill_diagonal(ok, False)
    if side.any():
        ok &= side[:, None] != side[None]
    return np.where(ok, jaccard, 0)


def _roots(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The smallest node of each node's connected part."""
    root = np.full(len(nodes), -1)
    for start in np.argsort(nodes):
        if root[start] >= 0:
            continue
        root[start] = start
        reach = np.array([start])
        while len(reach):
            new = linked[reach].any(0) & (root < 0)
            reach = np.flatnonzero(new)
            root[reach] = start
    return nodes[root]


def _units(batches: Iterator[pa.RecordBatch]):
    """The rows of each unit; batches are sorted by unit and cut anywhere."""
    key, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else []
        for i, j in zip(edges, edges[1:]):
            if keys[i] != key and held:
                yield pa.Table.from_batches(held)
                held = []
            key = keys[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _verifier(threshold: float, pairs: bool):
    """Of each unit its similar pairs; or for each node that is in one, the smallest node linked with it and its links.

    A link counts as often as there are copies of the other node.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            nodes, side, copies = (unit.column(k).to_numpy() for k in (1, 2, 3))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in unit.column(4)]
            jaccard = _similar(nodes, side, sets, threshold)
            if pairs:
                a, b = np.nonzero(jaccard)
                once = nodes[a] < nodes[b]
                a, b = a[once], b[once]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b]), pa.array(jaccard[a, b])], names=["a", "b", "jaccard"])
            else:
                linked = jaccard > 0
                some = np.flatnonzero(linked.any(1))
                linked = linked[np.ix_(some, some)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(_roots(linked, nodes[some])), pa.array(linked @ copies[some])], names=["node", "root", "links"])

    return verify


def _signed(docs: DataFrame, threshold: float, n: int, target_recall: float, max_hashes: int, seed: int) -> DataFrame:
    """Each document's node (null without words), number of n-grams and band values."""
    rows, bands = choose_bands(threshold, target_recall, max_hashes)
    kind = docs.schema["doc"].dataType.simpleString()
    return cut(docs.mapInArrow(_signer(n, rows, bands, seed), f"doc {kind}, node long, size long, bands array<long>"))


def _work(docs: DataFrame, nodes: DataFrame, n: int, block: int, block_grams: int) -> DataFrame:
    """The units' rows ``unit, node, side, copies, grams``, sorted by unit within partitions."""
    rows = nodes.select("node", "size", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("n")).filter("n > 1").select("band", "low")
    shared = cut(rows.join(buckets, "band"))
    label = shared.groupBy("node").agg(F.min("low").alias("label"), F.first("size").alias("size"))
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / block_grams))
    sizes = label.groupBy("label").agg(blocks.alias("blocks"))
    place = cut(label.join(sizes, "label").select("node", F.xxhash64("label", F.pmod(F.xxhash64("node"), "blocks")).alias("place")))

    met = shared.select("band", "node").join(place, "node").groupBy("band", "place").agg(F.count("*").alias("n"))
    met = cut(met)
    pair = met.select("band", F.col("place").alias("pa"), "n").join(met.select("band", F.col("place").alias("pb")), "band")
    pair = pair.filter("pa < pb OR pa = pb AND n > 1").select("pa", "pb").distinct()
    sides = pair.select(F.xxhash64("pa", "pb").alias("unit"), "pa", "pb")
    sides = sides.select("unit", F.col("pa").alias("place"), F.lit(0).alias("side")).unionAll(sides.filter("pa <> pb").select("unit", F.col("pb").alias("place"), F.lit(1).alias("side")))

    count = place.count()
    names = maybe_broadcast(nodes.join(place.select("node"), "node").select("doc", "node"), count)
    texts = docs.join(names, "doc").select("node", "text")
    sets = texts.mapInArrow(_setter(n), "node long, grams binary").dropDuplicates(["node"])
    members = sides.join(place.join(nodes.select("node", "copies"), "node"), "place")
    work = members.join(sets, "node").select("unit", "node", "side", "copies", "grams")
    return work.repartition("unit").sortWithinPartitions("unit")


def _prepared(docs: DataFrame, threshold: float, n: int, target_recall: float, max_hashes: int, seed: int, block: int, block_grams: int, id_col: str, text_col: str):
    docs = docs.select(col(docs, id_col).alias("doc"), col(docs, text_col).alias("text")).filter("doc IS NOT NULL")
    signed = _signed(docs, threshold, n, target_recall, max_hashes, seed)
    members = signed.select("node", "doc").filter("node IS NOT NULL").distinct()
    copies = members.groupBy("node").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"))
    bands = signed.filter("node IS NOT NULL").groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = cut(copies.join(bands, "node"))
    return signed, members, nodes, _work(docs, nodes, n, block, block_grams)


def jaccard_join(
    docs: DataFrame,
    threshold: float = 0.6,
    n: int = 3,
    target_recall: float = 0.995,
    max_hashes: int = 96,
    block: int = 512,
    block_grams: int = 1 << 20,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All pairs of different texts whose word n-gram sets have a Jaccard index of at least ``threshold``, and membership.

    Returns ``doc_a < doc_b, jaccard``. Documents with the same word sequence are
    a class, represented by the smallest id: pairs of texts are pairs of
    representatives, and each other member is paired with its own (jaccard 1).
    Any pair of documents follows from these. A pair at the threshold is found
    with probability ``target_recall``, more similar ones with a higher one; what
    is returned is verified exactly.

    Ids are of any type that has an order. Null, empty and word-less texts have no
    n-grams and match nothing; a text of fewer than ``n`` words has one gram of
    all its words. Rows with a null id can't be named and are left out. Repeated
    rows count once; an id that comes with several texts stands for each of them
    and is not paired with itself. An empty table gives no pairs. Other columns
    are ignored.
    """
    _, members, nodes, work = _prepared(docs, threshold, n, target_recall, max_hashes, seed, block, block_grams, id_col, text_col)
    near = work.mapInArrow(_verifier(threshold, True), "a long, b long, jaccard double")
    name = lambda end: nodes.select(F.col("node").alias(end), F.col("doc").alias("doc_" + end))
    near = near.join(name("a"), "a").join(name("b"), "b").filter("doc_a <> doc_b")
    near = near.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "jaccard")
    copied = nodes.filter("copies > 1").select("node", F.col("doc").alias("doc_a"))
    same = members.join(copied, "node").filter("doc_a < doc").select("doc_a", F.col("doc").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return near.unionAll(same)


def jaccard_classes(
    docs: DataFrame,
    threshold: float = 0.6,
    n: int = 3,
    target_recall: float = 0.995,
    max_hashes: int = 96,
    block: int = 512,
    block_grams: int = 1 << 20,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each id: ``id_col, class_id, links``.

    ``links`` is the number of other documents whose word n-gram sets have a
    Jaccard index of at least ``threshold`` with this one's, copies among them.
    ``class_id`` is the smallest id that can be reached over such links, the id
    itself if it has none. Both are made without writing any pair.

    For recall, ids, nulls, short and repeated texts see ``jaccard_join``. An id
    without words has no links; one that comes with several texts has the links
    of all of them (a document that is like two of them counts twice), and joins
    their classes. Null ids give no row. An empty table gives no rows.
    """
    signed, members, nodes, work = _prepared(docs, threshold, n, target_recall, max_hashes, seed, block, block_grams, id_col, text_col)
    found = cut(work.mapInArrow(_verifier(threshold, False), "node long, root long, links long"))
    several = members.groupBy("doc").agg(F.min("node").alias("root"), F.count("*").alias("n")).filter("n > 1")
    same = members.join(several, "doc").select("node", "root")
    parts = groups(found.select("node", "root").unionAll(same).filter("node <> root").toDF("doc_a", "doc_b"))
    links = found.groupBy("node").agg(F.sum("links").alias("near"))
    known = nodes.select("node", "doc", "copies").join(links, "node", "left").join(parts.select(F.col("doc").alias("node"), "root"), "node", "left")
    known = cut(known.select("node", F.coalesce("root", "node").alias("root"), "doc", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links")))
    first = known.groupBy("root").agg(F.min("doc").alias("class"))
    known = known.join(first, "root").select("node", "class", "links")
    out = signed.select("doc", "node").distinct().join(known, "node", "left")
    out = out.groupBy("doc").agg(F.min("class").alias("class"), F.sum("links").alias("links"))
    return out.select(F.col("doc").alias(id_col), F.coalesce("class", "doc").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def groups(pairs: DataFrame) -> DataFrame:
    """Connected components of the pairs: ``doc, root``, where root is the smallest id of the group.

    Alternates joining every node's larger and smaller neighbours to the
    smallest one, until no edge changes; each round is checkpointed. No pairs
    give no rows.
    """
    edges = cut(pairs.select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cut(small.union(low.toDF("u", "v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("root"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest id.

    Rows with a null id, and null, empty or word-less texts, are always kept.
    Of rows that repeat an id and text the one with the smallest row hash is kept.
    All columns pass through.
    """
    found = jaccard_classes(docs, id_col=id_col, text_col=text_col, **options).toDF("doc", "class", "links")
    name_gone, name_again, name_hash, name_rank = fresh(docs, "gone", "again", "hash", "rank")
    gone = cut(found.filter("doc <> class").select(F.col("doc").alias(name_gone)))
    kept = docs.join(maybe_broadcast(gone, gone.count()), col(docs, id_col) == F.col(name_gone), "left_anti")
    again = docs.filter(col(docs, id_col).isNotNull()).groupBy(col(docs, id_col).alias(name_again)).agg(F.count("*").alias("n"))
    again = cut(again.filter("n > 1").select(name_again))
    count = again.count()
    if not count:
        return kept
    side = maybe_broadcast(again, count)
    single = kept.join(side, col(kept, id_col) == F.col(name_again), "left_anti")
    repeated = kept.join(side, col(kept, id_col) == F.col(name_again), "left_semi")
    ident, text = col(repeated, id_col), col(repeated, text_col)
    one = Window.partitionBy(ident, F.xxhash64(text), F.hash(text)).orderBy(name_hash)
    whole = F.xxhash64(*[col(repeated, c) for c, kind in docs.dtypes if "map" not in kind])
    repeated = repeated.withColumn(name_hash, whole).withColumn(name_rank, F.row_number().over(one)).filter(F.col(name_rank) == 1)
    return single.unionAll(repeated.select(*[col(repeated, c) for c in docs.columns]))
