"""Best-fit packing of documents into windows by bin completion.

A document longer than a window fills whole windows of its own; what remains of
it is an item like any other. Items are spread by hash over buckets, and every
bucket (or, if asked for, every chunk of ``chunk`` of its items) is packed alone:
best-fit decreasing gives the incumbent, and branch and bound tries to beat it. A
branch completes the window of the largest item left with an undominated filling,
the least wasteful first, of these one with few and large items; the next one is
only looked for when the branch fails. A branch is cut when the waste so far
leaves no room for one window fewer. Only ids and lengths are shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, count_tokens


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices of the items of each window."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # room left, window, in order
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            insort(room, (capacity - sizes[i], len(bins) - 1))
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            insort(room, (left - sizes[i], b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Windows that any packing needs: by volume, by items so large that few stand in one, and by what must stand beside large items (Martello and Toth's L2)."""
    s = np.sort(np.array(sizes, np.int64))
    if not len(s):
        return 0
    half = np.searchsorted(s, capacity / 2, side="right")
    total = np.concatenate(([0], np.cumsum(s)))
    alpha = np.unique(np.append(s[:half], 0))
    large = np.maximum(np.searchsorted(s, capacity - alpha, side="right"), half)
    middle = large - half
    beside = total[half] - total[np.searchsorted(s, alpha)] - (middle * capacity - (total[large] - total[half]))
    few = (-(-np.arange(len(s), 0, -1) // (capacity // s))).max()
    return max(int(few), int((len(s) - large + middle + np.maximum(0, -(-beside // capacity))).max()))


class _Spent(Exception):
    pass


class _Search:
    """Bin completion over a multiset of sizes: ``counts[k]`` items of ``sizes[k]``, sizes descending."""

    def __init__(self, sizes: list[int], counts: list[int], capacity: int, nodes: int):
        self.sizes, self.counts, self.capacity, self.nodes = sizes, counts, capacity, nodes
        self.index = {s: k for k, s in enumerate(sizes)}
        self.negative = [-s for s in sizes]

    def _step(self) -> None:
        self.nodes -= 1
        if self.nodes < 0:
            raise _Spent

    def _dominated(self, taken: list[int], room: int) -> bool:
        """Whether some item left out could take the place of part of the filling and fit."""
        sums = 1
        for s in taken:
            sums |= sums << s
        have = set(taken)
        for k in range(bisect_left(self.negative, -room - sum(taken)), len(self.sizes)):
            s = self.sizes[k]
            if self.counts[k] and s not in have:
                low = max(1, s - room)
                if (sums >> low) & ((1 << (s - low + 1)) - 1):
                    return True
        return False

    def _exact(self, k: int, target: int, least: int, taken: list[int]) -> Iterator[list[int]]:
        """Sizes from the ``k``-th on, the larger first, that sum to the target, after those taken; few items first."""
        self._step()
        at = self.index.get(target)
        if at is not None and at >= k and self.counts[at] > taken.count(target):
            yield [*taken, target]
        for i in range(max(k, bisect_left(self.negative, least - target)), len(self.sizes)):
            s = self.sizes[i]
            if self.counts[i] > taken.count(s):
                yield from self._exact(i, target - s, least, [*taken, s])

    def _fillings(self, room: int, waste: int) -> Iterator[tuple[int, list[int]]]:
        """Undominated fillings of ``room`` that waste at most ``waste`` and can take no more items, one at a time."""
        least = next((s for s, n in zip(reversed(self.sizes), reversed(self.counts)) if n), room + 1)
        for left in range(0, min(waste, room) + 1):
            if left == room:
                if least > room:
                    yield left, []
                return
            for taken in self._exact(0, room - left, least, []):
                if left >= least and any(self.counts[k] > taken.count(self.sizes[k]) for k in range(bisect_left(self.negative, -left), len(self.sizes))):
                    continue
                if not self._dominated(taken, left):
                    yield left, taken

    def _take(self, sizes: list[int], sign: int) -> None:
        for s in sizes:
            self.counts[self.index[s]] -= sign

    def improve(self, most: int) -> list[list[int]] | None:
        """A packing into at most ``most`` windows, as sizes; None if there is none or the nodes are spent."""
        total = sum(s * n for s, n in zip(self.sizes, self.counts))
        waste = most * self.capacity - total
        if waste < 0:
            return None
        kept = list(self.counts)
        path: list[list] = []  # a window each: index of its largest item, waste left before it, fillings, the one in use

        def open_window(first: int, waste: int) -> bool:
            while first < len(self.sizes) and not self.counts[first]:
                first += 1
            if first == len(self.sizes):
                return False
            self.counts[first] -= 1
            path.append([first, waste, self._fillings(self.capacity - self.sizes[first], waste), []])
            return True

        try:
            if not open_window(0, waste):
                return []
            while path:
                window = path[-1]
                self._take(window[3], -1)
                left, window[3] = next(window[2], (None, []))
                if left is None:
                    self.counts[window[0]] += 1
                    path.pop()
                    continue
                self._take(window[3], 1)
                if not open_window(window[0], window[1] - left):
                    return [[self.sizes[first], *taken] for first, _, _, taken in path]
            return None
        except _Spent:
            return None
        finally:
            self.counts[:] = kept


def _fewer(sizes: list[int], capacity: int, most: int, nodes: int) -> tuple[list[list[int]] | None, int]:
    """Indices of the items of at most ``most`` windows, if the search finds them; and the nodes that are left."""
    values, counts = np.unique(np.array(sizes, np.int64), return_counts=True)
    search = _Search(values[::-1].tolist(), counts[::-1].tolist(), capacity, nodes)
    found = search.improve(most)
    if found is None:
        return None, search.nodes
    spare: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        spare.setdefault(sizes[i], []).append(i)
    return [[spare[s].pop() for s in b] for b in found], search.nodes


def pack(sizes: list[int], capacity: int, nodes: int, part: int = 48) -> list[list[int]]:
    """Indices of the items of each window; optimal unless the ``nodes`` of the search are spent first.

    A tenth of the nodes go to a search over all items. If they don't do, the
    others go to searches over ``part`` windows at a time, half of them the most
    wasteful ones and half drawn at random, for one window fewer. With spent nodes
    it is the incumbent, never worse than best-fit decreasing.
    """
    bins = best_fit(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    whole = nodes if len(bins) <= part else nodes // 10
    nodes -= whole
    while len(bins) > bound:
        found, whole = _fewer(sizes, capacity, len(bins) - 1, whole)
        if found is None:
            break
        bins = found
    rng = np.random.default_rng(len(sizes))
    while len(bins) > bound and nodes > 0 and len(bins) > part:
        waste = np.array([capacity - sum(sizes[i] for i in b) for b in bins])
        worst = np.argsort(-waste, kind="stable")
        if waste[worst[:part]].sum() < capacity:
            break
        some = np.concatenate((worst[: part // 2], rng.choice(worst[part // 2 :], part - part // 2, replace=False)))
        items = [i for b in some for i in bins[b]]
        give = min(nodes, 20_000)
        found, left = _fewer([sizes[i] for i in items], capacity, part - 1, give)
        nodes -= max(give - max(left, 0), 2000)
        if found is not None:
            gone = set(some.tolist())
            bins = [b for k, b in enumerate(bins) if k not in gone] + [[items[i] for i in b] for b in found]
    return bins


def _packer(capacity: int, chunk: int | None, nodes: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, number, held = None, 0, []

        def flush():
            nonlocal number, held
            if not held:
                return
            bins, place = [], []
            left, owner = [], []
            for k, (_, n) in enumerate(held):
                for w in range(n // capacity):
                    bins.append([(k, w * capacity, capacity)])
                if n % capacity:
                    left.append(n % capacity)
                    owner.append(k)
            for b in pack(left, capacity, nodes):
                bins.append([(owner[i], held[owner[i]][1] - left[i], left[i]) for i in b])
            for b, items in enumerate(bins):
                at = 0
                for k, start, n in items:
                    place.append((k, (bucket << 32) + number + b, at, start, n))
                    at += n
            number += len(bins)
            ids = pa.concat_arrays([i for i, _ in held])
            held = []
            columns = [pa.array(c, pa.int64()) for c in zip(*place)]
            yield pa.RecordBatch.from_arrays([ids.take(columns[0]), *columns[1:]], names=["id", "window", "at", "start", "tokens"])

        for batch in batches:
            for k, (b, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if b != bucket or len(held) == chunk:
                    yield from flush()
                    if b != bucket:
                        bucket, number = b, 0
                held.append((batch.column(1).slice(k, 1), n))
        yield from flush()

    return packed


def pack_documents(docs: DataFrame, capacity: int = 2048, chunk: int | None = None, bucket_rows: int = 8192, nodes: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lay every token of every document out in windows of ``capacity`` tokens.

    Returns ``id_col, window, at, start, tokens``: from token ``start`` of the
    document, ``tokens`` tokens stand in the window from its place ``at``. No
    window is overfull, no token is lost or repeated, and a document has no more
    pieces than it must have. Tokens are runs of anything but white space.
    ``nodes`` bounds the search of a bucket; what it found by then is used.

    Ids are of any type.
    Documents without tokens (null, empty or white text) have nothing to lay out
    and give no rows. A null id stays null. Repeated rows are separate documents.
    Ties in length are broken by the order of a hash of id and text. An empty
    table gives no rows. Other columns are ignored.
    """
    text = col(docs, text_col)
    kind = docs.select(col(docs, id_col)).schema[0].dataType.simpleString()
    items = docs.select(col(docs, id_col).alias("id"), count_tokens(text).alias("n"), F.xxhash64(col(docs, id_col), text).alias("h")).filter("n > 0")
    rows = docs.count()  # of the scan's footers, no text is read
    buckets = max(1, -(-rows // bucket_rows))
    items = items.select(F.pmod("h", F.lit(buckets)).cast("long").alias("bucket"), "id", "n", "h")
    items = items.repartition(max(1, min(buckets, 100_000)), "bucket").sortWithinPartitions("bucket", "h", "id", "n").select("bucket", "id", "n")
    laid = items.mapInArrow(_packer(capacity, chunk, nodes), f"id {kind}, window long, at long, start long, tokens long")
    return laid.select(F.col("id").alias(id_col), "window", "at", "start", "tokens")
