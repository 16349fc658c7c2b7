import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom import functions as fn
from fieldloom import plans
from fieldloom.operators import aggregates as ag
from fieldloom.operators import filters as pf
from fieldloom.operators import joins as jn
from fieldloom.operators import linear as la
from fieldloom.operators import metrics as me
from fieldloom.operators import similarity as si
from fieldloom.operators import windows as wi


def test_asof_tie_and_tolerance(spark):
    left = spark.sql("SELECT 1 AS id, timestamp'2021-01-01 03:00:00' AS t UNION ALL SELECT 2, timestamp'2021-01-02 03:00:00' UNION ALL SELECT 3, timestamp'2021-01-03 00:00:01'")
    right = spark.sql("SELECT explode(array(timestamp'2021-01-01 00:00:00', timestamp'2021-01-01 06:00:00', timestamp'2021-01-02 00:00:00', timestamp'2021-01-03 03:00:02')) AS r")
    got = {r.id: str(r.r) for r in jn.asof_nearest(left, right, "t", "r", 3 * 3600, "id").collect()}
    assert got == {1: "2021-01-01 00:00:00", 2: "2021-01-02 00:00:00"}
    free = {r.id: str(r.r) for r in jn.asof_nearest_unbounded(left, right, "t", "r").collect()}
    assert free == {1: "2021-01-01 00:00:00", 2: "2021-01-02 00:00:00", 3: "2021-01-03 03:00:02"}


def _most_rows(df) -> int:
    """The largest number of rows that a step of the plan gave out when ``df`` was collected."""

    def walk(plan):
        while (name := plan.nodeName()).startswith("AdaptiveSparkPlan") or name.endswith("QueryStage"):
            plan = plan.executedPlan() if name.startswith("AdaptiveSparkPlan") else plan.plan()
        n = plan.metrics().get("numOutputRows")
        return max([n.get().value() if n.isDefined() else 0, *[walk(plan.children().apply(i)) for i in range(plan.children().size())]])

    return walk(df._jdf.queryExecution().executedPlan())


def test_asof_makes_no_pairs(spark):
    """2,000 rows that all have 2,000 times within the tolerance."""
    at = lambda name, shift: spark.range(2000).select("id", F.timestamp_micros(1_600_000_000_000_000 + F.col("id") * 100_003 + shift).alias(name))
    got = jn.asof_nearest(at("t", 40_000), at("r", 0).drop("id"), "t", "r", 3600, "id")
    rows = got.collect()
    assert len(rows) == 2000 and {r.gap_s for r in rows} == {0.04} and got.columns == ["id", "t", "r", "gap_s"]
    assert 2000 <= _most_rows(got) < 3 * 4000


def test_asof_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    draw = lambda n: [(i, None if k == 3 else int(k), None if t % 41 == 0 else int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 4, n), rng.integers(-400, 400, n)))]
    left, right = draw(300), draw(60)
    frame = lambda rows, t: spark.createDataFrame(rows, "id int, k int, s long").select("id", "k", F.timestamp_micros(F.col("s") * 1_000_000).alias(t), F.lit("x").alias("_t" if t == "t" else "more"))
    for by in (["k"], None):
        for tolerance in (0, 1, 7, 5000):
            want = {}
            for i, k, t in left:
                near = [(abs(t - s), s) for _, j, s in right if t is not None and s is not None and abs(t - s) <= tolerance and (by is None or k is not None and j == k)]
                if near:
                    want[i] = min(near)
            got = jn.asof_nearest(frame(left, "t"), frame(right, "r"), "t", "r", tolerance, "id", by)
            assert got.columns == ["id", "k", "t", "_t", "r", "gap_s"]
            assert {r.id: (r.gap_s, r.s) for r in got.withColumn("s", F.unix_seconds("r")).collect()} == want


def test_bins_poles_and_wrap(spark):
    df = spark.createDataFrame([(90.0, 0.0), (-90.0, 359.9), (0.0, -10.0), (91.0, 0.0), (None, 1.0)], "lat double, lon double")
    got = [r[0] for r in df.select(jn.bin_cell(F.col("lat"), F.col("lon"))).collect()]
    assert got == [71 * 144, 143, 36 * 144 + 140, None, None]
    assert df.select(jn.bin_cell(F.col("lat"), F.col("lon"), keep_pole=False)).first()[0] is None


def test_mesh_and_radius(spark):
    points, faces, first = plans.icosphere(2)
    assert len(points) == 162 and len(faces) == 320 and (first == 0).sum() == 12 and np.allclose(np.linalg.norm(points, axis=1), 1)
    nodes = plans.mesh_nodes(spark, 2)
    assert plans.mesh_edges(spark, 2).count() == 480
    pts = np.random.default_rng(0).normal(size=(200, 3))
    pts /= np.linalg.norm(pts, axis=1)[:, None]
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(pts)], "p int, x double, y double, z double")
    got = {(r.p, r.node) for r in jn.radius_pairs(p, nodes, 0.2, "p", "node").collect()}
    d = np.linalg.norm(pts[:, None] - points[None], axis=2)
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 0.2))}
    values = p.select("p", F.when(F.col("p") % 7 == 0, float("nan")).otherwise(F.col("p") * 1.0).alias("v"))
    mean = {r.node: r.mean for r in ag.radius_mean(jn.radius_pairs(p, nodes, 0.2, "p", "node").join(values, "p"), nodes, "node", "v").collect()}
    for j in range(162):
        near = np.flatnonzero(d[:, j] <= 0.2)
        assert math.isclose(mean[j], sum(float(i) for i in near if i % 7) / max(1, len(near)), abs_tol=1e-9)


def test_missing_values(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [float("nan"), 1.0]), (2, [3.0, 4.0]), (3, None)], "t int, x array<double>")
    assert [r.t for r in pf.complete_steps(df, "t", "x").collect()] == [2]
    assert pf.complete_rows(df, ["x"]).count() == 2
    const = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert const.select(fn.pearson(F.col("a"), F.col("b"))).first()[0] is None


def test_leap_days(spark):
    df = spark.sql("SELECT explode(array(date'2020-02-28', date'2020-02-29', date'2020-03-01', date'2021-03-01', date'2020-12-31', date'2021-12-31')) AS d")
    assert [r[0] for r in df.select(fn.day_of_year_365(F.col("d"))).collect()] == [58, None, 59, 59, 364, 364]


def test_names(spark):
    df = spark.createDataFrame([("layer0008_x_t2021-03-04T06.npy",), ("gamma_-0.5.nc",), ("plain",)], "n string")
    got = df.select(fn.time_in_name(F.col("n")).cast("string"), fn.layer_in_name(F.col("n")), fn.gamma_in_name(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("2021-03-04 06:00:00", 8, None), (None, None, -0.5), (None, None, None)]
    f = spark.createDataFrame([("temperature_lev07",), ("msl",)], "n string").select(fn.feature_field(F.col("n")), fn.feature_level(F.col("n"))).collect()
    assert [tuple(r) for r in f] == [("temperature", 7), ("msl", None)]


def test_gaps_and_days(spark):
    df = spark.sql("SELECT explode(sequence(timestamp'2021-01-01', timestamp'2021-01-03', interval 6 hours)) AS t").filter("t <> timestamp'2021-01-02 06:00:00'")
    assert [str(r.t) for r in jn.missing_steps(df, "t", "2021-01-01", "2021-01-03", "6 HOURS").collect()] == ["2021-01-02 06:00:00"]
    assert {str(r.day): r.n for r in ag.incomplete_days(df, "t", "2021-01-01", "2021-01-04", 4).collect()} == {"2021-01-02": 3, "2021-01-03": 1, "2021-01-04": 0}


def test_trapezoid_and_transport(spark):
    rows = [(1, p * 100.0, 0.01, 10.0, 5.0) for p in (200, 500, 850, 1000)]
    df = spark.createDataFrame(rows, "k int, level double, q double, u double, v double")
    ivt = wi.vapour_transport(df, ["k"]).first().ivt
    assert math.isclose(ivt, 80000 * 0.01 * math.hypot(10, 5) / fn.GRAVITY, rel_tol=1e-12)


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5))
    y = x @ np.array([1.0, -2.0, 0.0, 0.5, 0.0]) + rng.normal(size=400)
    return np.c_[x, y]


def test_components_and_regressions(spark, matrix):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(matrix)] + [(-1, [float("nan")] * 6)], "i int, x array<double>")
    n, total, outer = la.gram(df, "x")
    assert n == 400 and np.allclose(outer, matrix.T @ matrix)
    b = la.pca(df, "x", 3)
    c = matrix - matrix.mean(0)
    value, v = np.linalg.eigh(c.T @ c / 400)
    assert np.allclose(np.abs(b.components @ v[:, ::-1][:, :3]), np.eye(3), atol=1e-8) and np.allclose(b.ratio, value[::-1][:3] / value.sum())
    s = {r.i: r.s for r in la.project(df.filter("i >= 0"), "x", b).collect()}
    assert np.allclose([s[i] for i in range(400)], c @ b.components.T)
    z = c[:, :5] / c[:, :5].std(0)
    coef, at = la.ridge(n, total, outer, [0, 1, 2, 3, 4], [5], 1.0)
    assert np.allclose(coef[:, 0], np.linalg.solve(z.T @ z + np.eye(5), z.T @ c[:, 5])) and np.allclose(at, matrix[:, 5].mean())
    w = la.elastic_net(n, total, outer, [0, 1, 2, 3, 4], 5, 0.05)
    r = z.T @ (c[:, 5] / c[:, 5].std() - z @ w) / 400
    assert (np.abs(r) <= 0.05 + 1e-8).all() and np.allclose(r[w != 0], 0.05 * np.sign(w[w != 0]))


def test_probe(spark, matrix):
    y = (matrix[:, 5] > 1).astype(int)
    df = spark.createDataFrame([(r[:5].tolist(), int(t)) for r, t in zip(matrix, y)], "x array<double>, y int")
    p = la.logistic_probe(df, "x", "y")
    z = np.c_[(matrix[:, :5] - matrix[:, :5].mean(0)) / matrix[:, :5].std(0), np.ones(400)]
    w = np.r_[p.coef, p.intercept]
    weight = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    grad = z.T @ (weight * (1 / (1 + np.exp(-z @ w)) - y)) + np.r_[p.coef, 0]
    assert np.abs(grad).max() < 1e-6
    assert la.logistic_probe(df.filter("y = 1"), "x", "y") is None
    got = la.probabilities(df, "x", p).agg(F.avg("p")).first()[0]
    assert math.isclose(got, (1 / (1 + np.exp(-z @ w))).mean(), rel_tol=1e-9)


def test_curve_metrics(spark):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 8, 60) / 8, rng.integers(0, 2, 60)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    order = sorted(set(s.tolist()), reverse=True)
    ap, last = 0.0, 0.0
    for t in order:
        tp = int(y[s >= t].sum())
        ap, last = ap + (tp / y.sum() - last) * tp / (s >= t).sum(), tp / y.sum()
    assert math.isclose(me.average_precision(me.pr_curve(df, "s", "y")).first()[0], ap, rel_tol=1e-12)
    auc = np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])
    assert math.isclose(me.roc_auc(df, "s", "y").first()[0], auc, rel_tol=1e-12)
    assert me.roc_auc(df.filter("y = 1"), "s", "y").first()[0] is None


def test_pair_means_without_pairs(spark):
    rng = np.random.default_rng(2)
    x, g = rng.normal(size=(20, 3)), rng.integers(0, 3, 20)
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(g, x)], "g int, x array<double>")
    got = {(r.a, r.b): r.sim for r in si.group_pair_means(df, "g", "x").collect()}
    for a in range(3):
        for b in range(3):
            want = [x[i] @ x[j] for i in range(20) for j in range(20) if g[i] == a and g[j] == b and i != j]
            assert math.isclose(got[a, b], np.mean(want), abs_tol=1e-9)


def test_periodicity_is_fft_share(spark):
    v = np.sin(np.arange(60) * 2 * np.pi / 12) + np.random.default_rng(0).normal(size=60) * 0.2
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    power = np.abs(np.fft.rfft(v - v.mean())) ** 2
    power[-1] /= 2  # the middle line has no twin
    assert math.isclose(si.periodicity(df, "v", 12).first()[0], power[5] / power.sum(), rel_tol=1e-6)


def test_bands_and_rankings(spark):
    df = spark.createDataFrame([(x,) for x in (1, 1, 5, 7, 9, 11, 20)], "l int")
    assert {r.l: r.band for r in ag.level_bands(df, "l").collect()} == {1: "lower", 5: "lower", 7: "mid", 9: "mid", 11: "upper", 20: "upper"}
    curve = spark.createDataFrame([("a", 1, 0.9), ("a", 7, 0.6), ("a", 30, 0.3), ("a", 180, 0.1)], "k string, lag int, mean double")
    r = si.lag_rankings(curve, "k").first()
    assert math.isclose(r.stability, 0.6) and math.isclose(r.change, 0.6) and r.seasonal is None


def test_screen_and_report(spark, matrix):
    rows = [(i % 2, i % 3, int(r[5] > 0), *r.tolist()) for i, r in enumerate(matrix)]
    df = spark.createDataFrame(rows, "t int, e int, y int, " + ", ".join(f"v{k} double" for k in range(6)))
    s = plans.screen(df, ["t"], {"a": F.col("v5")}, {"b": F.col("v0"), "c": F.col("v1"), "d": F.lit(1.0)})
    one = {(r.t, r.feature): r.r for r in s.collect()}
    m = matrix[0::2]
    assert math.isclose(one[0, "c"], np.corrcoef(m[:, 5], m[:, 1])[0, 1], rel_tol=1e-9) and one[0, "d"] is None
    assert plans.winners(s).filter("place = 1").first().wins <= 2
    x = df.withColumn("x", F.array(*[F.col(f"v{k}") for k in range(5)]))
    report = plans.probe_report(x.filter("t = 0"), x.filter("t = 1"), "x", "y", "e", [0.5])
    assert report["roc_auc"].first()[0] > 0.8 and report["events"].count() == 3


def test_reports_of_every_user_and_position(spark):
    from datetime import date, datetime, timedelta

    import __spark_entry__ as entry

    sf, q = "/root/testdata/sf0.001", entry.queries()
    start, steps = datetime(2024, 1, 1), [datetime(2024, 1, 1) + timedelta(hours=6 * k) for k in range(120)]
    have = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts")).collect():
        have.setdefault(r.user_id, set()).add(start + (r.ts - start) // timedelta(hours=6) * timedelta(hours=6))
    plain = lambda df, *c: sorted(tuple(r) for r in df.select("user_id", *[F.col(x).cast("timestamp_ntz") if x == "step" else F.col(x) for x in c]).collect())
    assert plain(q["gap_report"](spark, sf), "step") == sorted((u, s) for u, own in have.items() for s in steps if s not in own)
    days = [(date(2024, 1, 1) + timedelta(days=k)) for k in range(30)]
    count = {(u, d): sum(s.date() == d for s in own) for u, own in have.items() for d in days}
    assert plain(q["incomplete_days"](spark, sf), "day", "n") == sorted((u, d, n) for (u, d), n in count.items() if n != 4)
    six = timedelta(hours=6)
    assert plain(q["three_step_window"](spark, sf), "step") == sorted((u, s) for u, own in have.items() for s in own if s - six in own and s + six in own)

    x = np.array([r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect()], dtype=float)
    want = np.corrcoef(x.T)
    got = q["screen_correlations"](spark, sf).collect()
    n = x.shape[1]
    assert {(r.component, r.feature) for r in got} == {(f"c{a}", f"f{b:02d}") for a in range(n) for b in range(n) if a != b}
    assert all(abs(r.r - want[int(r.component[1:]), int(r.feature[1:])]) < 2e-6 for r in got)
    assert {r.component for r in q["screen_winners_by_group"](spark, sf).collect()} == {f"c{k}" for k in range(n)}


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "t timestamp, x array<double>, v double, k int")
    assert la.gram(df, "x")[0] == 0 and ag.step_stats(df, ["k"], "v").count() == 0
    assert pf.complete_steps(df, "t", "x").count() == 0 and me.pr_curve(df, "v", "k").count() == 0
    assert jn.with_neighbours(df, "t", "6 HOURS").count() == 0 and ag.histogram(df, "v", 5).count() == 0


def test_grids_of_fits(spark, matrix):
    """Every cell of the grid against predictions made row by row."""
    train, test = matrix[:300], matrix[300:]
    sums = [la.gram(spark.createDataFrame([(r.tolist(),) for r in m], "x array<double>"), "x") for m in (train, test)]
    z = (train - train.mean(0)) / train.std(0)
    zt = (test - train.mean(0)) / train.std(0)
    for y, n, alpha, _, r2, rmse, corr in la.fit_grid(*sums, [0, 1, 2, 3], [4, 5], [2, 4], [0.5, 50.0]):
        w = np.linalg.solve(z[:, :n].T @ z[:, :n] + alpha * np.eye(n), z[:, :n].T @ train[:, y])
        f = zt[:, :n] @ w + train[:, y].mean()
        e = test[:, y] - f
        assert np.allclose([r2, rmse, corr], [1 - (e @ e) / ((test[:, y] - test[:, y].mean()) ** 2).sum(), np.sqrt((e @ e) / 100), np.corrcoef(f, test[:, y])[0, 1]])
    best = la.best_alpha([(0, 1, 0.1, 1, 0.5), (0, 1, 1.0, 1, 0.5), (0, 1, 2.0, 1, 0.4)])
    assert best == [(0, 1, 0.1, 1, 0.5)]
    w, r2 = la.ols(*sums[0], [0, 1, 2, 3], 5)
    assert np.allclose(w, np.linalg.lstsq(z[:, :4], train[:, 5] - train[:, 5].mean(), rcond=None)[0])
    assert math.isclose(r2, 1 - ((train[:, 5] - train[:, 5].mean() - z[:, :4] @ w) ** 2).sum() / (300 * train[:, 5].var()))


def test_gram_of_groups_and_jobs(spark, matrix):
    rows = [(int(i) % 3 or None, f"k{i % 2}", r.tolist()) for i, r in enumerate(matrix)] + [(9, "few", [1.0] * 6), (9, "few", [2.0] * 6)]
    df = spark.createDataFrame(rows, "g int, k string, x array<double>").repartition(16)
    got = {(r.g, r.k): la.unfold(r.data) for r in la.grouped_gram(df, ["g", "k"], "x").collect()}
    for g in (None, 1, 2):
        for k in ("k0", "k1"):
            own = matrix[[i for i in range(400) if (i % 3 or None) == g and f"k{i % 2}" == k]]
            n, total, outer = got[g, k]
            assert n == len(own) and np.allclose(total, own.sum(0)) and np.allclose(outer, own.T @ own)
    assert got[9, "few"][0] == 2 and np.allclose(got[9, "few"][2], 5.0)
    tracker = spark.sparkContext.statusTracker()
    count = []
    for parts in (2, 32):
        spark.sparkContext.setJobGroup(f"gram{parts}", "")
        la.gram(df.repartition(parts), "x")
        count.append(len(tracker.getJobIdsForGroup(f"gram{parts}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(count) <= min(count) + 1


def test_running_sums_in_pieces(spark):
    rng = np.random.default_rng(4)
    v = sorted({round(float(x), 6) for x in rng.exponential(size=500)})
    df = spark.createDataFrame([(x, i % 7) for i, x in enumerate(v)], "v double, n int")
    got = {r.v: (r.up, r.run_n) for r in wi.running_sums(df, "v", ["n"], descending=True).withColumn("up", F.lit(0)).collect()}
    down = {r.v: r.run_n for r in wi.running_sums(df, "v", ["n"], before=True).collect()}
    n = np.array([i % 7 for i in range(len(v))])
    assert all(got[x][1] == n[i:].sum() and down[x] == n[:i].sum() for i, x in enumerate(v))


def test_screen_ignores_incomplete_rows(spark):
    nan = float("nan")
    rows = [(float(i), 2.0 * i, float(i * i % 7)) for i in range(12)] + [(nan, 5.0, 1.0), (3.0, None, 1.0), (1e9, 1.0, nan), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    out = {r.feature: r for r in plans.screen(df, [], {"a": F.col("a")}, {"b": F.col("b"), "c": F.col("c"), "k": F.lit(2.0)}).collect()}
    assert math.isclose(out["b"].r, 1.0) and out["b"].rank == 1 and out["k"].r is None and out["k"].rank == 3
    assert plans.screen(df.limit(5), [], {"a": F.col("a")}, {"b": F.col("b")}).count() == 0
    ranks = {r.f: r.rank for r in wi.ranked(spark.createDataFrame([("x", nan), ("y", 0.2), ("z", None)], "f string, s double"), [], "s", "f").collect()}
    assert ranks == {"y": 1, "x": 2, "z": 3}
    assert math.isclose(df.select(fn.pearson(F.col("a"), F.col("b"))).first()[0], np.corrcoef([*range(12), 1e9], [*range(0, 24, 2), 1.0])[0, 1])
    assert math.isclose(me.residual_metrics(df.filter("a < 100 OR a IS NULL"), "a", "b").first().rmse, math.sqrt(np.mean([i * i for i in range(12)])))


def test_strict_matches_and_windows(spark):
    a = spark.createDataFrame([(1, 0.1, 0.2, 0.3), (2, 0.4, 0.5, 0.6)], "n int, x double, y double, z double")
    b = a.select(F.col("n").alias("m"), "x", "y", "z")
    assert jn.match_by_place(a, b, strict=True).count() == 2
    for wrong in (b.limit(1), b.unionAll(b)):
        with pytest.raises(ValueError):
            jn.match_by_place(a, wrong, strict=True)
    with pytest.raises(ValueError):
        jn.join_all(a, b.filter("m = 1").withColumnRenamed("m", "n").select("n"), ["n"])
    t = spark.sql("SELECT explode(sequence(timestamp'2021-01-01', timestamp'2021-01-03', interval 6 hours)) AS t")
    jn.require_window(t.filter("t = timestamp'2021-01-01 06:00:00'"), t, "t", 1, 7)
    with pytest.raises(ValueError):
        jn.require_window(t, t, "t", 1, 7)
    with pytest.raises(ValueError):
        ag.day_climatology(t.select(fn.day_of_year_365(F.col("t")).alias("d"), F.lit(1.0).alias("v")), "d", "v")
    with pytest.raises(ValueError):
        pf.select_leads(t, [], "t", "middle")
    one = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "i int, x array<double>")
    assert sorted(pf.scramble(one, "x").first().x) == [1.0, 2.0, 3.0] and pf.scramble(one, "x").first() == pf.scramble(one.repartition(3), "x").first()
    assert abs(plans.longest_edge(3) - 0.1651) < 5e-3
    assert np.allclose(fn.log_grid(-1, 1, 3), [0.1, 1.0, 10.0])
    m = spark.createDataFrame([("mask_20210304_06.nc",), ("m20210304.nc",), ("2021-03-04T18.nc",), ("none",)], "n string")
    assert [str(r[0]) for r in m.select(fn.mask_time_in_name(F.col("n"))).collect()] == ["2021-03-04 06:00:00", "2021-03-04 00:00:00", "2021-03-04 18:00:00", "None"]
