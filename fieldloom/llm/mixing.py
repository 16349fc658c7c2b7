"""Mixing sources by temperature.

A source with n tokens gets the weight n^a / sum(n^a). The exponent a is bisected
so that the weights have a wanted entropy, or so that no source is repeated more
often than a limit. Weights times the token budget are the sources' budgets. Each
source is cut into blocks of about ``block_tokens`` by a hash of the id; every
epoch is a new permutation of the blocks, and blocks are taken until the budget is
spent; of the block in which it ends, documents are taken in hash order as far as
they fit.

Only the vector of source totals reaches the driver. Windows run over blocks, not
documents, in two levels of sums, and inside the one block of a source in which
its budget ends, so a large source is not one task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, col, count_tokens, cut, fresh, maybe_broadcast


def weights(totals: np.ndarray, exponent: float) -> np.ndarray:
    scaled = np.log(totals) * exponent
    scaled = np.exp(scaled - scaled.max())
    return scaled / scaled.sum()


def entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def repetition(totals: np.ndarray, exponent: float, budget: float | None) -> float:
    """Epochs of the most repeated source; without a budget, of the least that covers every source once."""
    epochs = weights(totals, exponent) / totals
    return float((epochs * budget if budget else epochs / epochs.min()).max())


def find_exponent(totals: np.ndarray, target_entropy: float | None, max_repetition: float | None, budget: float | None, steps: int = 60) -> float:
    """The exponent in [0, 1], rounded to 9 places, by bisection.

    With ``target_entropy``, a share of the highest possible one, the exponent
    that reaches it (1 if natural shares exceed it). With ``max_repetition``, the
    smallest exponent within that limit; with both, the larger one.
    """

    def bisect(too_low) -> float:
        if not too_low(0.0):
            return 0.0
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if too_low(mid) else (lo, mid)
        return hi

    found = 0.0
    if len(totals) < 2:
        return 1.0
    if target_entropy is not None:
        found = bisect(lambda a: entropy(weights(totals, a)) > target_entropy * math.log(len(totals)))
    if max_repetition is not None:
        found = max(found, bisect(lambda a: repetition(totals, a, budget) > max_repetition))
    return round(found, 9)


def _hash(*parts):
    """31 bits of the MD5 of the parts, as SQL engines agree on them; nulls are written as \\N."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repetition: float | None = None,
    budget: float | str = "total",
    block_tokens: int = 100_000,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    extra: tuple[str, str, str, str] | None = ("epoch", "block", "slot", "tokens"),
) -> DataFrame:
    """The documents of the mixture, one row for each time that a document is used.

    ``budget`` is a number of tokens, ``"total"`` (those of the input) or
    ``"cover"`` (the smallest that has every source at least once, whole).
    ``extra`` names four columns: the epoch from 0, the block, the share of its
    source's stream at which the block starts (sorting by it interleaves the
    sources at their weights), and the tokens; None adds none. All columns of the
    input pass through. No source exceeds its budget; it falls short of it by
    less than the first document that doesn't fit.

    Null is a source like any other. Documents without tokens (null, empty or
    white text) can't fill a budget and are left out. A single source has the
    weight 1. Repeated rows count as often as they occur; rows that tie in id are
    taken in the order of tokens, then text. An empty table gives no rows.
    """
    n_epoch, n_block, n_slot, n_tok = fresh(docs, *(extra or ("epoch", "block", "slot", "tokens")))
    n_src, n_total, n_left, n_rank, n_cum = fresh(docs, "src", "total", "left", "rank", "cum")
    ident, source, text = col(docs, id_col), col(docs, source_col), col(docs, text_col)
    place = _hash(F.lit(seed), F.lit("block"), ident)
    blocks_of = lambda total: F.greatest(F.lit(1), F.ceil(F.col(total) / block_tokens))

    # Texts are cut into tokens once for all that is planned; the plan needs sums over sources and places alone.
    counted = cut(docs.select(source.alias("src"), place.alias("place"), count_tokens(text).alias("tokens")).filter("tokens > 0").groupBy("src", "place").agg(F.sum("tokens").alias("tokens")))
    totals = cut(counted.groupBy("src").agg(F.sum("tokens").alias("total")))
    vector = np.array([r[0] for r in totals.select("total").toLocalIterator()], dtype=float)
    vector.sort()
    if not len(vector):
        vector = np.ones(1)
    tokens = None if budget == "cover" else float(vector.sum()) if budget == "total" else float(budget)
    exponent = find_exponent(vector, target_entropy, max_repetition, tokens)
    share = weights(vector, exponent)
    if tokens is None:
        tokens = float((vector / share).max())
    log_max = math.log(vector[-1])
    norm = float(np.exp((np.log(vector) - log_max) * exponent).sum())
    weight = F.exp((F.log("total") - log_max) * exponent) / norm
    whole_budget = F.floor(weight * tokens + 1e-6)
    if budget == "cover":  # rounding must not take the last document of the source that sets the budget
        whole_budget = F.greatest(whole_budget, F.col("total"))
    totals = totals.select("src", "total", whole_budget.alias("budget"))

    n_sources = totals.count()
    of = maybe_broadcast(totals.withColumnRenamed("src", "of"), n_sources)
    blocks = counted.join(of, F.col("src").eqNullSafe(F.col("of"))).withColumn("block", F.pmod("place", blocks_of("total")))
    blocks = cut(blocks.groupBy("src", "block", "total", "budget").agg(F.sum("tokens").alias("tokens")))
    plan = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("budget") - 1e-9) / F.col("total")).cast("int")))).filter("budget > 0")
    # A permutation's running sums in two levels, so that the blocks of a large source are not ordered in one task.
    plan = plan.withColumn("order", _hash(F.lit(seed), F.col("epoch"), F.col("block"))).withColumn("coarse", F.floor(F.col("order") / (1 << 18)))
    coarse = plan.groupBy("src", "epoch", "coarse").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("src", "epoch").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select(F.col("src").alias("c_src"), F.col("epoch").alias("c_epoch"), F.col("coarse").alias("c"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    plan = plan.join(coarse, F.col("src").eqNullSafe(F.col("c_src")) & (F.col("epoch") == F.col("c_epoch")) & (F.col("coarse") == F.col("c")))
    order = Window.partitionBy("src", "epoch", "coarse").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("start", F.col("epoch") * F.col("total") + F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    plan = plan.filter("start < budget")
    left = F.col("budget") - F.col("start")
    plan = cut(plan.select("src", "block", "epoch", F.round(F.col("start") / F.col("budget"), 9).alias("slot"), F.when(left < F.col("tokens"), left).alias("left")))
    n_plan = plan.count()
    plan = plan.select(F.col("src").alias(n_src), F.col("block").alias(n_block), F.col("epoch").alias(n_epoch), F.col("slot").alias(n_slot), F.col("left").alias(n_left))

    # Rows find their blocks by id alone. The two branches split the plan, so both are map-side while it is small enough to broadcast.
    n_of, n_src_p, n_block_p = fresh(docs, n_src + "_of", n_src + "_p", n_block + "_p")
    side = totals.select(F.col("src").alias(n_of), F.col("total").alias(n_total))
    usable = docs.filter(text.rlike("[^ \\t\\n\\r]")).join(maybe_broadcast(side, n_sources), source.eqNullSafe(F.col(n_of)))
    usable = usable.withColumn(n_block_p, F.pmod(place, blocks_of(n_total)))

    def with_plan(part: DataFrame) -> DataFrame:
        right = maybe_broadcast(part, n_plan, BROADCAST_ROWS)
        return usable.join(right, (F.col(n_block_p) == F.col(n_block)) & F.col(n_of).eqNullSafe(F.col(n_src)))

    whole = with_plan(plan.filter(F.col(n_left).isNull())).withColumn(n_tok, count_tokens(text))
    last = with_plan(plan.filter(F.col(n_left).isNotNull())).withColumn(n_tok, count_tokens(text))
    within = Window.partitionBy(n_src, n_epoch, n_block).orderBy(F.col(n_rank), ident, F.col(n_tok), text).rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn(n_rank, _hash(F.lit(seed), F.col(n_epoch), ident)).withColumn(n_cum, F.sum(n_tok).over(within)).filter(F.col(n_cum) <= F.col(n_left))
    names = [*docs.columns, *([n_epoch, n_block, n_slot, n_tok] if extra else [])]
    pick = lambda df: df.select(*[col(df, c) for c in names])
    return pick(whole).unionAll(pick(last))
