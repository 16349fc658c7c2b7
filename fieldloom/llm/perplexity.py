"""Quality by n-gram perplexity under a modified Kneser-Ney model.

Character n-grams of every text are counted by Spark. Texts are halved by a hash;
a text is scored under the model of the other half, so none is in its own model
(exact copies share a half) and every text is counted. Below the highest order,
counts are those of distinct left extensions; discounts follow Chen and Goodman.

All n-grams with the same two characters before the last one meet in a bucket, so
a bucket holds every count and context of orders 3 to 5 that its n-grams need; the
two lowest orders are small tables of a language. N-grams travel as compressed
columns, once. The probability of every n-gram that occurs is interpolated once,
and kept as sorted arrays of hashes and log probabilities; texts look theirs up
in these, in as many rounds as ``array_bytes`` asks for. Perplexities are judged
against a band of each language around its median.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import col, cut

ORDER = 5
_BOS = 1  # stands before a text; a U+0001 in a text counts as U+0020
_W = np.uint64(21)
_MASK = np.uint64((1 << 21) - 1)
_SLICE = 1 << 20
_HELD = 1 << 22


def _grams(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low half of every n-gram of a slice (3 and 2 code points), and each text's offset."""
    c, at = tv.codes(b, o)
    n_docs, pad = len(o) - 1, ORDER - 1
    c = np.where(c == _BOS, 32, c).astype(np.uint64)
    where = np.arange(len(c)) + np.repeat(np.arange(1, n_docs + 1) * pad, np.diff(at))
    p = np.full(len(c) + n_docs * pad, _BOS, np.uint64)
    p[where] = c
    two = (p[:-1] << _W) | p[1:] if len(p) else p
    lo = two[where - 1]
    hi = (two[where - 4] << _W) | p[where - 2]
    return hi, lo, at


def _hash(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return tv.mix(hi * np.uint64(0x9E3779B97F4A7C15) + lo)


def _unpack(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return np.stack([hi >> np.uint64(42), (hi >> _W) & _MASK, hi & _MASK, lo >> _W, lo & _MASK])


def _distinct(hi: np.ndarray, lo: np.ndarray, n: np.ndarray | None = None):
    """Distinct n-grams with their counts; one flat sort where code points are small."""
    if n is None and len(hi):
        five = _unpack(hi, lo)
        if five.max() < 4096:
            key = five[0]
            for c in five[1:]:
                key = (key << np.uint64(12)) | c
            key, n = np.unique(key, return_counts=True)
            c = [(key >> np.uint64(s)) & np.uint64(4095) for s in (48, 36, 24, 12, 0)]
            return (c[0] << np.uint64(42)) | (c[1] << _W) | c[2], (c[3] << _W) | c[4], n
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    first = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))) if len(hi) else np.zeros(0, int)
    n = np.ones(len(hi), np.int64) if n is None else n[order]
    return hi[first], lo[first], np.add.reduceat(n, first) if len(first) else n[:0]


def _freeze(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted n-grams and counts as compressed byte planes."""
    planes = [c.astype("<u4").view(np.uint8).reshape(-1, 4).T for c in _unpack(hi, lo)] + [n.astype("<u8").view(np.uint8).reshape(-1, 8).T]
    raw = np.ascontiguousarray(np.concatenate(planes)).tobytes()
    return len(hi).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _thaw(blob) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blob = memoryview(blob)
    m = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=28 * m, codec="zstd", asbytes=True), np.uint8).reshape(28, m)
    c = [np.ascontiguousarray(raw[4 * k : 4 * k + 4].T).view("<u4")[:, 0].astype(np.uint64) for k in range(ORDER)]
    n = np.ascontiguousarray(raw[20:].T).view("<u8")[:, 0].astype(np.int64)
    return (c[0] << np.uint64(42)) | (c[1] << _W) | c[2], (c[3] << _W) | c[4], n


def _keys(lang: pa.Array, half: pa.Array) -> tuple[np.ndarray, list[tuple[str, int]]]:
    """Each row's number of language and half, and what the numbers stand for."""
    coded = lang.dictionary_encode()
    names = coded.dictionary.to_pylist()
    return coded.indices.to_numpy() * 2 + half.to_numpy(), [(n, h) for n in names for h in (0, 1)]


def _counter(buckets: int):
    def count(batches):
        held: dict[tuple[str, int], list] = {}
        waiting: dict[tuple[str, int], int] = {}

        def merge(k):
            held[k] = [_distinct(*(np.concatenate(x) for x in zip(*held[k])))]
            waiting[k] = 0

        def emit(k):
            hi, lo, n = held.pop(k)[0]
            at = (tv.mix((hi & _MASK) << _W | lo >> _W) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            hi, lo, n, at = hi[order], lo[order], n[order], at[order]
            some, first = np.unique(at, return_index=True)
            blobs = [_freeze(hi[i:j], lo[i:j], n[i:j]) for i, j in zip(first, np.append(first[1:], len(at)))]
            return pa.RecordBatch.from_arrays([pa.array([k[0]] * len(some), pa.string()), pa.array(some), pa.array(np.full(len(some), k[1])), pa.array(blobs, pa.binary())], names=["lang", "bucket", "half", "grams"])

        for batch in batches:
            of, names = _keys(batch.column(0), batch.column(1))
            for g in np.unique(of):
                b_all, o_all = tv.buffers(batch.column(2).take(pa.array(np.flatnonzero(of == g))))
                k = names[g]
                for i, j in tv.slices(o_all, _SLICE):
                    found = _distinct(*_grams(b_all[o_all[i] : o_all[j]], o_all[i : j + 1] - o_all[i])[:2])
                    held.setdefault(k, []).append(found)
                    waiting[k] = waiting.get(k, 0) + len(found[0])
                    if waiting[k] > 1 << 21:
                        merge(k)
                        if len(held[k][0][0]) > _HELD:
                            yield emit(k)
        for k in list(held):
            merge(k)
            yield emit(k)

    return count


def _suffixes(hi: np.ndarray, lo: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Keys of the suffixes of 5, 4 and 3 characters, and of the contexts before their last one."""
    tail = hi & ((np.uint64(1) << np.uint64(42)) - np.uint64(1))
    return {
        5: (_hash(hi, lo), _hash(hi, lo >> _W)),
        4: (_hash(tail, lo), (tail << _W) | lo >> _W),
        3: ((hi & _MASK) << np.uint64(42) | lo, (hi & _MASK) << _W | lo >> _W),
    }


def _levels(hi: np.ndarray, lo: np.ndarray, n: np.ndarray):
    """Orders 5, 4 and 3: types with their counts and contexts; and the pairs of characters with theirs."""
    out, c, rows = {}, n, np.arange(len(hi))
    keys = _suffixes(hi, lo)
    for k in (5, 4, 3):
        own, context = keys[k]
        if k == 5:
            order = np.argsort(own)
            own, context, c, rows = own[order], context[order], n[order], order
        else:
            own, first, c = np.unique(own[rows], return_index=True, return_counts=True)
            rows = rows[first]
            context = context[rows]
        out[k] = (own, c, context)
    return out, np.unique(lo[rows], return_counts=True)


def _merger(batches):
    """Of each language and bucket the two halves' n-grams, how many types have a count of 1 to 4, and pairs of characters."""
    key, held = None, {}

    def flush():
        row = {"lang": [key[0]], "bucket": [key[1]]}
        facts = []
        for half in (0, 1):
            if half not in held:
                row[f"grams{half}"] = [None]
                continue
            merge(half)
            grams = held[half][0]
            row[f"grams{half}"] = [_freeze(*grams)]
            levels, (pairs, count) = _levels(*grams)
            facts.append((half, 2, pairs.astype(np.int64), count))
            facts += [(half, k, np.arange(1, 5), np.bincount(np.minimum(levels[k][1], 5), minlength=6)[1:5]) for k in (3, 4, 5)]
        sizes = [len(f[2]) for f in facts]
        columns = [np.repeat([f[0] for f in facts], sizes), np.repeat([f[1] for f in facts], sizes), np.concatenate([f[2] for f in facts]), np.concatenate([f[3] for f in facts])]
        packed = pa.compress(np.stack(columns).astype(np.int64).tobytes(), codec="zstd", asbytes=True)
        row |= {"n": [sum(sizes)], "facts": [packed]}
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("grams0", pa.binary()), ("grams1", pa.binary()), ("n", pa.int64()), ("facts", pa.binary())]))

    def merge(half):
        if len(held[half]) > 1:
            held[half] = [_distinct(*(np.concatenate(x) for x in zip(*held[half])))]

    waiting = 0
    for batch in batches:
        for lang, bucket, half, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
            if (lang, bucket) != key:
                if key is not None:
                    yield flush()
                key, held, waiting = (lang, bucket), {}, 0
            held.setdefault(half, []).append(_thaw(blob.as_buffer()))
            waiting += len(held[half][-1][0])
            if waiting > _HELD:
                for k in held:
                    merge(k)
                waiting = 0
    if key is not None:
        yield flush()


def _facts(batches):
    for batch in batches:
        for lang, n, packed in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
            half, kind, key, count = np.frombuffer(pa.decompress(packed.as_buffer(), decompressed_size=32 * n, codec="zstd"), np.int64).reshape(4, n)
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * n, pa.string()), *(pa.array(x) for x in (half, kind, key, count))], names=["lang", "half", "kind", "key", "n"])


def _sums(groups: np.ndarray, *values: np.ndarray):
    """Sorted distinct groups and the sums of the values over each."""
    some, of = np.unique(groups, return_inverse=True)
    return some, *(np.bincount(of, weights=v, minlength=len(some)) for v in values)


def _own(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array(d)[np.minimum(c, 3) - 1] if len(c) else np.zeros(0)


def _low(t: pa.Table) -> pa.Table:
    """A language's discounts, and its models of one and two characters, from all its facts."""
    half, kind, key, n = (t.column(k).to_numpy() for k in ("half", "kind", "key", "n"))
    chars = len(np.unique(key[kind == 2] & ((1 << 21) - 1)))
    out = {}
    for h in np.unique(half):
        d = []
        for k in (3, 4, 5):
            have = dict(zip(key[(half == h) & (kind == k)].tolist(), n[(half == h) & (kind == k)].tolist()))
            d.append(discounts(*(have.get(i, 0) for i in (1, 2, 3, 4))))
        pick = (half == h) & (kind == 2)
        order = np.argsort(key[pick])
        pairs, c = key[pick][order].astype(np.uint64), n[pick][order]
        kinds = lambda x: discounts(*np.bincount(np.minimum(x, 5), minlength=6)[1:5].tolist())
        own = _own(c, kinds(c))
        context, total, mass = _sums(pairs >> _W, c, own)
        last, c1 = np.unique(pairs & _MASK, return_counts=True)
        own1 = _own(c1, kinds(c1))
        back = own1.sum() / (chars + 1)
        out |= {f"d{h}": np.array(d), f"chars{h}": last, f"p{h}": (c1 - own1 + back) / c1.sum(), f"unseen{h}": np.array([back / c1.sum()])}
        out |= {f"context{h}": context, f"back{h}": mass / total, f"pairs{h}": pairs, f"rest{h}": (c - own) / total[np.searchsorted(context, pairs >> _W)]}
    held = io.BytesIO()
    np.savez(held, **out)
    return pa.table({"lang": t.column("lang").slice(0, 1), "low": pa.array([held.getvalue()], pa.binary())})


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other) -> np.ndarray:
    """The values of the wanted among sorted keys, and ``other`` for those that aren't there."""
    if not len(keys):
        return np.broadcast_to(np.asarray(other, float), wanted.shape)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def _index(keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """Where the keys with each value of their top bits start; about one key to a value."""
    bits = max(1, int(len(keys)).bit_length())
    shift = np.uint64(64 - bits)
    start = np.zeros((1 << bits) + 1, np.int32 if len(keys) < 1 << 31 else np.int64)
    np.cumsum(np.bincount((keys >> shift).astype(np.int64), minlength=1 << bits), out=start[1:])
    return start[:-1], shift


def _find_hashed(keys: np.ndarray, values: np.ndarray, index: tuple[np.ndarray, np.uint64], wanted: np.ndarray) -> np.ndarray:
    """As ``_find`` does, 0 for what isn't there, among hashes: a step from the start that the top bits give, not a search."""
    if not len(keys):
        return np.zeros(len(wanted))
    start, shift = index
    at = np.minimum(start[(wanted >> shift).astype(np.int64)].astype(np.int64), len(keys) - 1)
    todo = np.flatnonzero(keys[at] < wanted)
    while len(todo):
        at[todo] += 1
        todo = todo[at[todo] < len(keys)]
        todo = todo[keys[at[todo]] < wanted[todo]]
    at = np.minimum(at, len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def _scorer_table(batches):
    """Of a language's bucket, each half's n-grams with their log probabilities under the other half."""
    for batch in batches:
        for i in range(batch.num_rows):
            lang, bucket = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            with np.load(io.BytesIO(batch.column(4)[i].as_py())) as z:
                low = dict(z)
            blobs = [batch.column(2 + h)[i] for h in (0, 1)]
            grams = {h: _thaw(blobs[h].as_buffer()) for h in (0, 1) if blobs[h].is_valid}
            for half, (hi, lo, _) in grams.items():
                m = 1 - half if f"d{1 - half}" in low else half
                context, char = lo >> _W, lo & _MASK
                p = _find(low[f"chars{m}"], low[f"p{m}"], char, low[f"unseen{m}"][0])
                p = np.where(np.isin(context, low[f"context{m}"]), _find(low[f"pairs{m}"], low[f"rest{m}"], lo, 0.0) + _find(low[f"context{m}"], low[f"back{m}"], context, 0.0) * p, p)
                levels = _levels(*grams[m])[0] if m in grams else {}
                for k in (3, 4, 5) if levels else ():
                    types, c, before = levels[k]
                    own = _own(c, low[f"d{m}"][k - 3])
                    some, total, mass = _sums(before, c, own)
                    suffix, x = _suffixes(hi, lo)[k]
                    total_x = _find(some, total, x, np.nan)
                    better = (_find(types, c - own, suffix, 0.0) + _find(some, mass, x, 0.0) * p) / total_x
                    p = np.where(np.isnan(total_x), p, better)
                h = _hash(hi, lo)
                order = np.argsort(h)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([half]), pa.array([bucket]), pa.array([len(h)]), pa.array([h[order].tobytes()], pa.binary()), pa.array([np.log(p[order]).astype(np.float32).tobytes()], pa.binary())], names=["lang", "half", "bucket", "n", "h", "logp"])


def _prepared(docs: DataFrame, id_col: str, lang_col: str, text_col: str) -> DataFrame:
    """Rows ``id, lang, text, key, half``: key stands for the language and isn't null, half is the text's."""
    rows = docs.select(col(docs, id_col).alias("id"), col(docs, lang_col).cast("string").alias("lang"), col(docs, text_col).alias("text"))
    key = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "lang"))
    return rows.withColumn("key", key).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("long"))


def probabilities(rows: DataFrame) -> DataFrame:
    """Of every n-gram of a language's half, its log probability under the model of the other half.

    Rows ``lang, half, bucket, n, h, logp``; the last two are arrays of ``n``
    sorted hashes and of 4-byte floats. A language with only one half has no
    other model; it is scored under its own.
    """
    buckets = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = rows.filter("length(text) > 0").select("key", "half", "text")
    counted = texts.mapInArrow(_counter(buckets), "lang string, bucket long, half long, grams binary")
    counted = counted.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    merged = cut(counted.mapInArrow(_merger, "lang string, bucket long, grams0 binary, grams1 binary, n long, facts binary"))
    facts = merged.select("lang", "n", "facts").mapInArrow(_facts, "lang string, half long, kind long, key long, n long")
    facts = facts.groupBy("lang", "half", "kind", "key").agg(F.sum("n").alias("n"))
    low = facts.groupBy("lang").applyInArrow(_low, "lang string, low binary")
    joined = merged.select("lang", "bucket", "grams0", "grams1").join(low, "lang")
    return cut(joined.mapInArrow(_scorer_table, "lang string, half long, bucket long, n long, h binary, logp binary"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney; where a count of counts is 0, 0.5, 1 and 1.5 times at most their count."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(float(min(max(r, 0.05), k)) for k, r in zip((1, 2, 3), raw))


def _rounds(table: DataFrame, array_bytes: int) -> list[tuple[int, int]]:
    """Ranges of buckets of about ``array_bytes`` of hashes and probabilities; at least a bucket each."""
    out, held = [], 0
    for r in table.groupBy("bucket").agg((F.sum("n") * 12).alias("bytes")).orderBy("bucket").collect():
        if not out or held + r.bytes > array_bytes:
            out.append((r.bucket, r.bucket))
            held = 0
        out[-1] = (out[-1][0], r.bucket)
        held += r.bytes
    return out


def _arrays(table: DataFrame, buckets: tuple[int, int]) -> dict:
    got: dict[tuple[str, int], list] = {}
    for r in table.filter(F.col("bucket").between(*buckets)).toArrow().to_batches():
        for lang, half, h, logp in zip(*(r.column(k).to_pylist() for k in (0, 1)), r.column(4), r.column(5)):
            got.setdefault((lang, half), []).append((np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(logp.as_buffer(), np.float32)))
    out = {}
    for k in list(got):
        h, logp = (np.concatenate(x) for x in zip(*got.pop(k)))
        order = np.argsort(h)
        out[k] = (h[order], logp[order])
    return out


def _looked_up(rows: DataFrame, held) -> DataFrame:
    """``rows`` with a struct ``score``: the sum of the log probabilities that are held, and the number of characters."""

    def score(lang: pa.Array, half: pa.Array, text: pa.Array) -> pa.Array:
        total, length = np.zeros(len(text)), np.zeros(len(text), np.int64)
        of, names = _keys(lang, half)
        for g in np.unique(of):
            at = np.flatnonzero(of == g)
            arrays = held.value.setdefault(names[g], (np.zeros(0, np.uint64), np.zeros(0, np.float32)))
            if len(arrays) == 2:  # once in a worker
                arrays = held.value[names[g]] = (*arrays, _index(arrays[0]))
            hashes, values, index = arrays
            b_all, o_all = tv.buffers(text.take(pa.array(at)))
            for i, j in tv.slices(o_all):
                hi, lo, first = _grams(b_all[o_all[i] : o_all[j]], o_all[i : j + 1] - o_all[i])
                total[at[i:j]] = tv.sum_by(_find_hashed(hashes, values, index, _hash(hi, lo)), first)
                length[at[i:j]] = np.diff(first)
        return pa.StructArray.from_arrays([pa.array(total), pa.array(length)], names=["total", "length"])

    score.__annotations__ = {"lang": pa.Array, "half": pa.Array, "text": pa.Array, "return": pa.Array}
    return rows.withColumn("score", F.arrow_udf(score, "total double, length long")("key", "half", "text"))


def _scored(rows: DataFrame, table: DataFrame, array_bytes: int) -> DataFrame:
    """``id, lang, total, length`` of every row; of several rounds each adds its share, by two hashes of the row."""
    rounds = _rounds(table, array_bytes)
    sc = rows.sparkSession.sparkContext
    if len(rounds) <= 1:
        found = _looked_up(rows, sc.broadcast(_arrays(table, rounds[0]) if rounds else {}))
        return found.select("id", "lang", F.col("score.total").alias("total"), F.col("score.length").alias("length"))
    rows = rows.withColumn("a", F.xxhash64("id", "text")).withColumn("b", F.hash("text", "id"))
    parts = None
    for k, buckets in enumerate(rounds):
        held = sc.broadcast(_arrays(table, buckets))
        part = cut(_looked_up(rows, held).select("a", "b", F.lit(k).alias("round"), "score"))
        held.destroy()
        parts = part if parts is None else parts.unionAll(part)
    once = parts.groupBy("a", "b", "round").agg(F.first("score").alias("score"))
    sums = once.groupBy("a", "b").agg(F.sum("score.total").alias("total"), F.max("score.length").alias("length"))
    return rows.select("id", "lang", "a", "b").join(sums, ["a", "b"]).select("id", "lang", "total", "length")


def _middle(hist: DataFrame, value: str) -> DataFrame:
    """Per language the smallest value at which half of the rows are reached."""
    w = Window.partitionBy("lang")
    run = hist.withColumn("run", F.sum("n").over(w.orderBy(value))).withColumn("all", F.sum("n").over(w))
    return run.filter(F.col("run") * 2 >= F.col("all")).groupBy("lang").agg(F.min(value).alias("mid"))


def bands(scored: DataFrame) -> DataFrame:
    """Per language, in thousandths of log perplexity, the median and the median distances below and above it."""
    bins = F.round(F.col("ppl") * 1000).cast("long")
    hist = cut(scored.filter("ppl IS NOT NULL").groupBy("lang", bins.alias("bin")).agg(F.count("*").alias("n")))
    mid = _middle(hist, "bin")
    off = hist.join(mid.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of"))).withColumn("dev", F.abs(F.col("bin") - F.col("mid")))
    sides = []
    for side, where in (("low", F.col("bin") <= F.col("mid")), ("high", F.col("bin") >= F.col("mid"))):
        part = off.filter(where).groupBy("lang", "dev").agg(F.sum("n").alias("n"))
        sides.append(_middle(part, "dev").select(F.col("lang").alias("of_" + side), F.col("mid").alias(side)))
    out = mid.join(sides[0], F.col("lang").eqNullSafe(F.col("of_low"))).join(sides[1], F.col("lang").eqNullSafe(F.col("of_high")))
    return out.select("lang", "mid", "low", "high")


def perplexity_verdicts(
    docs: DataFrame,
    width: float = 6.0,
    least: float = 0.05,
    short: int = 400,
    array_bytes: int = 128 << 20,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: id, language, characters scored, log perplexity, band, verdict.

    Columns: ``id_col``, ``lang_col``, ``chars``, ``log_perplexity``, ``lower``,
    ``upper``, ``rejected``. The band of a language is its median less and plus
    ``width`` times 1.4826 the median distance on that side (at least ``least``);
    for a text of c characters it is sqrt(1 + short / c) times as wide. A text is
    rejected if it lies outside, above or below. ``array_bytes`` is what may be
    sent to every task at once; a larger model takes more rounds over the texts.

    Null is a language like any other. A null or empty text has 0 characters, no
    perplexity and no band, and isn't rejected. Repeated rows come out as often as
    they come in, and count as often. An empty table gives no rows. Other columns
    of ``docs`` are ignored, whatever their names.
    """
    rows = _prepared(docs, id_col, lang_col, text_col)
    scored = _scored(rows, probabilities(rows), array_bytes)
    ppl = F.when(F.col("length") > 0, F.round(-F.col("total") / F.greatest("length", F.lit(1)), 6))
    scored = cut(scored.select("id", "lang", "length", ppl.alias("ppl")))
    limits = bands(scored)
    out = scored.join(F.broadcast(limits.withColumnRenamed("lang", "of")) if limits.count() <= 100_000 else limits.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left")
    wide = F.sqrt(1 + F.lit(float(short)) / F.greatest("length", F.lit(1))) * width
    reach = lambda side: wide * F.greatest(F.col(side) * 1.4826 / 1000, F.lit(least))
    has = F.col("length") > 0
    lower = F.when(has, F.round(F.col("mid") / 1000 - reach("low"), 6))
    upper = F.when(has, F.round(F.col("mid") / 1000 + reach("high"), 6))
    verdict = F.coalesce((F.col("ppl") < lower) | (F.col("ppl") > upper), F.lit(False))
    return out.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), F.col("length").alias("chars"), F.col("ppl").alias("log_perplexity"), lower.alias("lower"), upper.alias("upper"), verdict.alias("rejected"))
