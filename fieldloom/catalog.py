"""All queries of the library by name, with the same in DuckDB SQL where SQL can say it.

Every query runs over whole tables. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import clip, component_name, day_of_year_365, feature_field, feature_level, lead_label, log_grid, micros, month_bounds, nearest_six_hours, pearson, project, season_angles, solar_hour, valid_time
from .operators import aggregates as ag
from .operators import filters as pf
from .operators import joins as jn
from .operators import linear as la
from .operators import metrics as me
from .operators import similarity as si
from .operators import windows as wi
from . import streaming as st
from .plans import longest_edge, mesh_nodes, screen, winners

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


_LONG = "l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"
_R = f"""{_LONG}, p AS (
  SELECT {{step}} 'c' || a.pos AS component, 'f' || lpad(b.pos::VARCHAR, 2, '0') AS feature, count(*) AS n,
    CASE WHEN stddev_pop(a.v) * stddev_pop(b.v) = 0 THEN NULL ELSE covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) END AS r
  FROM l a JOIN l b USING (vec_id) WHERE a.pos <> b.pos GROUP BY ALL HAVING count(*) >= 10),
k AS (SELECT *, row_number() OVER (PARTITION BY {{step}} component ORDER BY abs(r) DESC NULLS LAST, feature) AS rank FROM p)"""


def _screened(spark, sf, step: list[str]) -> DataFrame:
    """Every position as a component against every other one."""
    e = _t(spark, sf, "embeddings")
    at = lambda k: F.get("embedding", F.lit(k))
    every = range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)
    return screen(e, step, {f"c{k}": at(k) for k in every}, {f"f{k:02d}": at(k) for k in every}, apart={f"c{k}": f"f{k:02d}" for k in every})


@query(f"WITH {_R.format(step='')} SELECT component, feature, round(r, 6) AS r, rank FROM k")
def screen_correlations(spark, sf):
    return _screened(spark, sf, []).select("component", "feature", F.round("r", 6).alias("r"), F.col("rank").cast("long").alias("rank"))


_K = _R.format(step="a.label,").replace("PARTITION BY a.label,", "PARTITION BY label,")


@query(f"""WITH {_K}, s AS (SELECT component, feature, avg(abs(r)) AS m, count(r) AS "count", count(*) FILTER (rank = 1 AND r IS NOT NULL) AS wins FROM k GROUP BY ALL HAVING count(r) > 0),
q AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY m DESC, wins DESC, feature) AS place FROM s)
SELECT component, feature, round(m, 6) AS mean_abs_r, "count", wins, place FROM q WHERE place <= 5""")
def screen_winners_by_group(spark, sf):
    w = winners(_screened(spark, sf, ["label"]), 5)
    return w.select("component", "feature", F.round("mean_abs_r", 6).alias("mean_abs_r"), "count", "wins", F.col("place").cast("long").alias("place"))


@query("""WITH m AS (SELECT list_transform(embedding, lambda v: v::DOUBLE - 0.1) AS x, vec_id FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: x[i] * (i % 3))), 6) AS s1, round(list_sum(list_transform(range(1, 65), lambda i: x[i] * (i % 5 - 2))), 6) AS s2 FROM m""")
def project_fixed_basis(spark, sf):
    s = project(F.col("embedding"), [0.1] * 64, [[i % 3 for i in range(1, 65)], [i % 5 - 2 for i in range(1, 65)]])
    return _t(spark, sf, "embeddings").withColumn("s", s).select("vec_id", F.round(F.get("s", F.lit(0)), 6).alias("s1"), F.round(F.get("s", F.lit(1)), 6).alias("s2"))


@query(f"WITH {_LONG} SELECT label, pos::INTEGER AS pos, round(avg(v), 6) AS mean FROM l GROUP BY ALL")
def node_mean_by_group(spark, sf):
    return _r(ag.vector_mean(_t(spark, sf, "embeddings"), ["label"], "embedding"), "mean")


@query(f"WITH {_LONG}, d AS (SELECT pos, avg(v) FILTER (label = 0) - avg(v) FILTER (label = 1) AS delta FROM l GROUP BY pos) SELECT pos::INTEGER AS pos, round(delta, 6) AS delta FROM d ORDER BY abs(delta) DESC, pos LIMIT 10")
def group_delta_topk(spark, sf):
    d = ag.group_delta(_t(spark, sf, "embeddings"), "embedding", F.col("label") == 0, F.col("label") == 1)
    return _r(d.orderBy(F.desc(F.abs("delta")), "pos").limit(10), "delta")


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS step, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(abs(value)), 6) AS mean_abs FROM events GROUP BY 1""")
def step_stats(spark, sf):
    e = _t(spark, sf, "events").withColumn("step", F.window("ts", "6 hours")["start"])
    return _r(ag.step_stats(e, ["step"], "value"), "mean", "std", "min", "max", "mean_abs")


@query("SELECT ts::DATE AS day, event_type, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def daily_mean(spark, sf):
    return _t(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH o AS (SELECT o_totalprice AS v, dayofyear(o_orderdate) AS d, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap FROM orders)
SELECT (d - 1 - CASE WHEN leap AND d > 60 THEN 1 ELSE 0 END)::INTEGER AS doy, round(avg(v), 6) AS mean, count(*) AS n FROM o WHERE NOT (leap AND d = 60) GROUP BY 1""")
def doy_climatology(spark, sf):
    o = _t(spark, sf, "orders").withColumn("doy", day_of_year_365(F.col("o_orderdate"))).filter("doy IS NOT NULL")
    return o.groupBy("doy").agg(F.round(F.avg("o_totalprice"), 6).alias("mean"), F.count("*").alias("n"))


@query("SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8), 6) AS z FROM events WINDOW w AS (PARTITION BY ts::DATE)")
def zscore_in_group(spark, sf):
    e = _t(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), "value")
    return _r(wi.zscore(e, ["day"], "value"), "z").select("event_id", "z")


@query("""WITH c AS (SELECT event_id, event_type, value - avg(value) OVER (PARTITION BY event_type) AS c FROM events)
SELECT event_id, round(c / greatest(sqrt(sum(c * c) OVER (PARTITION BY event_type)), 1e-8), 6) AS unit FROM c""")
def unit_norm_in_group(spark, sf):
    return _r(wi.unit_norm(_t(spark, sf, "events"), ["event_type"], "value"), "unit").select("event_id", "unit")


@query(f"""WITH {_LONG}, v AS (SELECT pos, var_pop(v) AS var FROM l GROUP BY pos)
SELECT pos::INTEGER AS pos, round(var / sum(var) OVER (), 6) AS share, round(sum(var) OVER (ORDER BY var DESC, pos ROWS UNBOUNDED PRECEDING) / sum(var) OVER (), 6) AS cum FROM v""")
def cum_explained(spark, sf):
    v = _t(spark, sf, "embeddings").select(F.posexplode("embedding").alias("pos", "v")).groupBy("pos").agg(F.var_pop(F.col("v").cast("double")).alias("var"))
    return _r(ag.cumulative_share(v, "var", [F.desc("var"), F.col("pos")]), "share", "cum").select("pos", "share", "cum")


_TYPES = ["click", "error", "purchase", "signup", "view"]
_DAYS = "d AS (SELECT ts::DATE AS day, " + ", ".join(f"coalesce(sum(value) FILTER (event_type = '{t}'), 0) AS x{k}" for k, t in enumerate(_TYPES)) + " FROM events GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM d)"
_COS = "(" + " + ".join(f"a.x{k} * b.x{k}" for k in range(5)) + ") / (sqrt(" + " + ".join(f"a.x{k} * a.x{k}" for k in range(5)) + ") * sqrt(" + " + ".join(f"b.x{k} * b.x{k}" for k in range(5)) + "))"


def _daily_maps(spark, sf) -> DataFrame:
    sums = [F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("value"))), F.lit(0.0)) for t in _TYPES]
    return jn.numbered(_t(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.array(*sums).alias("x")), "day")


@query(f"WITH {_DAYS} SELECT lag, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS std, count(*) AS pairs FROM (SELECT (b.i - a.i)::INTEGER AS lag, {_COS} AS sim FROM s a JOIN s b ON b.i - a.i IN (1, 3, 7, 14)) GROUP BY lag")
def lag_curve(spark, sf):
    return _r(si.lag_curve(_daily_maps(spark, sf), "x", [1, 3, 7, 14]), "mean", "std")


@query(f"WITH {_DAYS} SELECT lag, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS std, count(*) AS pairs FROM (SELECT lag, {_COS} AS sim FROM (SELECT unnest([1, 3, 7, 14]) AS lag) g, s a JOIN s b ON b.i = (a.i + lag) % a.n) GROUP BY lag")
def circular_lag_curve(spark, sf):
    return _r(si.lag_curve(_daily_maps(spark, sf), "x", [1, 3, 7, 14], circular=True), "mean", "std")


@query(f"""WITH {_DAYS}, z AS (SELECT i, [{', '.join(f'x{k}' for k in range(5))}] AS x FROM s), y AS (SELECT i, list_transform(x, lambda v: (v - list_avg(x)) / (list_stddev_pop(x) + 1e-8)) AS z FROM z),
m AS (SELECT a.i AS i, b.i AS j, greatest(-1, least(1, list_dot_product(a.z, b.z) / 5)) AS sim FROM y a, y b)
SELECT round(avg(sim) FILTER (i <> j), 6) AS mean, round(stddev_pop(sim) FILTER (i <> j), 6) AS std, round(min(sim) FILTER (i <> j), 6) AS min, round(max(sim) FILTER (i <> j), 6) AS max, round(avg(sim) FILTER (j - i = 1), 6) AS lag_1, round(avg(sim) FILTER (j - i = 7), 6) AS lag_7 FROM m""")
def pattern_stability(spark, sf):
    return _r(si.off_diagonal(si.all_pairs(_daily_maps(spark, sf), "x"), [1, 7]), "mean", "std", "min", "max", "lag_1", "lag_7")


_SLOT = "v AS (SELECT ts::DATE AS day, (hour(ts) // 6)::INTEGER AS slot, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS x{k}" for k, t in enumerate(_TYPES)) + " FROM events GROUP BY ALL)"
_PAIRMEAN = f"""{_SLOT}, m AS (SELECT a.slot AS a, b.slot AS b, avg({' + '.join(f'a.x{k} * b.x{k}' for k in range(5))}) AS sim FROM v a JOIN v b ON a.slot <> b.slot OR a.day <> b.day GROUP BY ALL)"""


def _slots(spark, sf) -> DataFrame:
    counts = [F.count_if(F.col("event_type") == t) for t in _TYPES]
    v = _t(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.floor(F.hour("ts") / 6).cast("int").alias("slot")).agg(F.array(*counts).alias("x"))
    return si.group_pair_means(v, "slot", "x")


@query(f"WITH {_PAIRMEAN} SELECT a, b, round(sim, 6) AS sim FROM m")
def hour_pair_similarity(spark, sf):
    return _r(_slots(spark, sf), "sim")


@query(f"WITH {_PAIRMEAN}, g AS (SELECT avg(sim) FILTER (a = b) AS s, avg(sim) FILTER ((b - a + 4) % 4 = 2) AS o FROM m) SELECT round(s, 6) AS same, round(o, 6) AS opposite, round(s - o, 6) AS contrast FROM g")
def diurnal_scores(spark, sf):
    return _r(si.diurnal_scores(_slots(spark, sf)), "same", "opposite", "contrast")


@query("""WITH d AS (SELECT ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1), s AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, v - avg(v) OVER () AS v, count(*) OVER () AS n FROM d),
k AS (SELECT max(n) AS n, greatest(1, round_even(max(n) / 7.0, 0)) AS k FROM s)
SELECT round((pow(sum(v * cos(i * 2 * pi() * k.k / k.n)), 2) + pow(sum(v * sin(i * 2 * pi() * k.k / k.n)), 2)) / (sum(v * v) * max(k.n) / 2 + 1e-8), 6) AS share FROM s, k""")
def weekly_periodicity(spark, sf):
    d = jn.numbered(_t(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v")), "day")
    return _r(si.periodicity(d, "v", 7), "share")


@query("""WITH c AS (SELECT p.event_id, p.ts, e.ts AS error_ts, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(e.ts)), e.ts) AS k
FROM (SELECT * FROM events WHERE event_type = 'purchase') p JOIN (SELECT DISTINCT ts FROM events WHERE event_type = 'error') e ON abs(epoch_us(p.ts) - epoch_us(e.ts)) <= 900000000)
SELECT event_id, ts, error_ts, abs(epoch_us(ts) - epoch_us(error_ts)) / 1e6 AS gap_s FROM c WHERE k = 1""")
def asof_nearest(spark, sf):
    e = _t(spark, sf, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "ts")
    right = e.filter("event_type = 'error'").select(F.col("ts").alias("error_ts"))
    return jn.asof_nearest(left, right, "ts", "error_ts", 900, "event_id")


@query("""WITH c AS (SELECT p.event_id, e.ts AS error_ts, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(e.ts)), e.ts) AS k
FROM (SELECT * FROM events WHERE event_type = 'purchase') p, (SELECT DISTINCT ts FROM events WHERE event_type = 'error') e) SELECT event_id, error_ts FROM c WHERE k = 1""")
def asof_nearest_unbounded(spark, sf):
    e = _t(spark, sf, "events")
    return jn.asof_nearest_unbounded(e.filter("event_type = 'purchase'").select("event_id", "ts"), e.filter("event_type = 'error'").select(F.col("ts").alias("error_ts")), "ts", "error_ts").select("event_id", "error_ts")


_USER = "WITH u AS (SELECT DISTINCT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS step FROM events), w AS (SELECT DISTINCT user_id FROM u)"


def _user_steps(spark, sf) -> DataFrame:
    return _t(spark, sf, "events").select("user_id", F.window("ts", "6 hours")["start"].alias("step"))


@query(_USER + " SELECT user_id, g AS step FROM w, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 18:00:00', INTERVAL 6 HOUR) t(g) WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = w.user_id AND u.step = g)")
def gap_report(spark, sf):
    return jn.missing_steps(_user_steps(spark, sf), "step", "2024-01-01 00:00:00", "2024-01-31 00:00:00", "6 HOURS", ("user_id",))


@query("SELECT user_id, event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_report(spark, sf):
    return ag.duplicates(_t(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").alias("day")), ["user_id", "event_type", "day"])


@query(_USER + ", c AS (SELECT user_id, step::DATE AS day, count(*) AS n FROM u GROUP BY ALL) SELECT w.user_id, g::DATE AS day, coalesce(n, 0) AS n FROM (SELECT * FROM w, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) t(g)) w LEFT JOIN c ON c.day = g::DATE AND c.user_id = w.user_id WHERE coalesce(n, 0) <> 4")
def incomplete_days(spark, sf):
    return ag.incomplete_days(_user_steps(spark, sf), "step", "2024-01-01", "2024-01-30", 4, ("user_id",))


@query(_USER + " SELECT user_id, step FROM u WHERE EXISTS (SELECT 1 FROM u a WHERE a.user_id = u.user_id AND a.step = u.step + INTERVAL 6 HOUR) AND EXISTS (SELECT 1 FROM u a WHERE a.user_id = u.user_id AND a.step = u.step - INTERVAL 6 HOUR)")
def three_step_window(spark, sf):
    return jn.with_neighbours(_user_steps(spark, sf), "step", "6 HOURS", ("user_id",))


@query("""WITH s AS (SELECT DISTINCT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS step FROM events WHERE event_type = 'signup'), m AS (SELECT DISTINCT ts FROM events WHERE event_type = 'error')
SELECT step FROM s WHERE EXISTS (SELECT 1 FROM m WHERE abs(epoch_us(m.ts) - epoch_us(step) - 21600000000) <= 600000000) AND EXISTS (SELECT 1 FROM m WHERE abs(epoch_us(m.ts) - epoch_us(step) - 432000000000) <= 600000000)""")
def starts_with_both_ends(spark, sf):
    e = _t(spark, sf, "events")
    starts = e.filter("event_type = 'signup'").select(F.window("ts", "6 hours")["start"].alias("step"))
    return jn.starts_with_both_ends(starts, e.filter("event_type = 'error'").select(F.col("ts").alias("m")), "step", "m", 21600, 432000, 600).select("step")


@query("SELECT floor((c_acctbal + 1000) / 500)::BIGINT AS cell, round(avg(c_acctbal), 6) AS mean, count(*) AS n FROM customer GROUP BY 1")
def bin_mean(spark, sf):
    return _r(ag.cell_mean(_t(spark, sf, "customer").withColumn("cell", F.floor((F.col("c_acctbal") + 1000) / 500)), "cell", "c_acctbal"), "mean")


@query("""WITH g AS (SELECT c_custkey % 181 - 90 AS lat, (c_custkey * 7) % 400 - 20 AS lon, c_acctbal AS v FROM customer)
SELECT (least(floor((lat + 90) / 2.5), 71) * 144 + floor(((lon % 360) + 360) % 360 / 2.5))::INTEGER AS cell, round(avg(v), 6) AS mean, count(*) AS n FROM g GROUP BY 1""")
def grid_bin_mean(spark, sf):
    g = _t(spark, sf, "customer").select((F.col("c_custkey") % 181 - 90).cast("double").alias("lat"), ((F.col("c_custkey") * 7) % 400 - 20).cast("double").alias("lon"), "c_acctbal")
    return _r(ag.cell_mean(g.withColumn("cell", jn.bin_cell(F.col("lat"), F.col("lon"))), "cell", "c_acctbal"), "mean")


@query("WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT least(floor((p_retailprice - lo) * 20 / (hi - lo)), 19)::BIGINT AS bin, count(*) AS n FROM part, e GROUP BY 1")
def histogram20(spark, sf):
    return ag.histogram(_t(spark, sf, "part"), "p_retailprice", 20)


@query("SELECT t.target, arg_min(s.p_size, [abs(s.p_size - t.target), s.p_size]) AS p_size FROM (SELECT unnest([0, 7, 23, 60]) AS target) t, (SELECT DISTINCT p_size FROM part) s GROUP BY 1")
def nearest_level(spark, sf):
    return pf.nearest_level(_t(spark, sf, "part"), "p_size", spark.createDataFrame([(x,) for x in (0, 7, 23, 60)], "target int"), "target")


_DAYTYPE = "d AS (SELECT ts::DATE AS day, event_type, avg(value) AS v FROM events GROUP BY ALL)"


@query(f"WITH {_DAYTYPE} SELECT a.day, a.event_type, round(a.v, 6) AS v, round(b.v, 6) AS control_value, round(a.v - b.v, 6) AS delta FROM d a JOIN d b ON a.day = b.day AND b.event_type = 'view'")
def control_delta(spark, sf):
    d = _t(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.avg("value").alias("v"))
    return _r(jn.against_control(d, ["day"], "event_type", "view", "v"), "v", "control_value", "delta")


@query("""SELECT l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS whole, round(sum(l_extendedprice * l_quantity) FILTER (l_returnflag = 'R') / sum(l_quantity) FILTER (l_returnflag = 'R'), 6) AS inside,
round(sum(l_extendedprice * l_quantity) FILTER (l_returnflag <> 'R') / sum(l_quantity) FILTER (l_returnflag <> 'R'), 6) AS outside, round(max(l_extendedprice) FILTER (l_returnflag = 'R'), 6) AS max_inside, round(avg((l_returnflag = 'R')::INTEGER), 6) AS fraction FROM lineitem GROUP BY 1""")
def masked_weighted_mean(spark, sf):
    v, w, m = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_returnflag") == "R"
    out = _t(spark, sf, "lineitem").groupBy("l_linestatus").agg(ag.weighted_mean(v, w).alias("whole"), ag.weighted_mean(v, w, m).alias("inside"), ag.weighted_mean(v, w, ~m).alias("outside"), F.max(F.when(m, v)).alias("max_inside"), F.avg(m.cast("int")).alias("fraction"))
    return _r(out, "whole", "inside", "outside", "max_inside", "fraction")


@query("""WITH n AS (SELECT user_id, epoch_us(ts) / 1e6 - 1.7e9 AS x, value AS y, event_id FROM (SELECT user_id, ts, avg(value) AS value, min(event_id) AS event_id FROM events GROUP BY ALL)),
p AS (SELECT user_id, lead(x) OVER w - x AS dx, y + lead(y) OVER w AS s FROM n WINDOW w AS (PARTITION BY user_id ORDER BY x)) SELECT user_id, round(coalesce(sum(dx * s / 2), 0) / 86400, 4) AS integral FROM p GROUP BY 1""")
def trapezoid_integral(spark, sf):
    e = _t(spark, sf, "events").groupBy("user_id", "ts").agg(F.avg("value").alias("value")).withColumn("x", micros(F.col("ts")) / 1e6 - 1.7e9)
    return wi.trapezoid(e, ["user_id"], "x", F.col("value")).select("user_id", F.round(F.col("integral") / 86400, 4).alias("integral"))


@query("SELECT doc_id, min(l)::INTEGER AS intersection, max(l)::INTEGER AS \"union\", avg(l) AS soft FROM (SELECT doc_id, quality AS l FROM labels UNION ALL SELECT doc_id, toxic FROM labels) GROUP BY 1")
def annotator_combine(spark, sf):
    x = _t(spark, sf, "labels").select("doc_id", F.explode(F.array("quality", "toxic")).alias("l"))
    return ag.combine_annotators(x, ["doc_id"], "l")


_SCORED = "s AS (SELECT lang, quality AS y, least(n_chars, 10000) / 10000 AS p FROM labels JOIN documents USING (doc_id))"


def _scored(spark, sf) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return _t(spark, sf, "labels").join(d, "doc_id").select("lang", F.col("quality").alias("y"), clip(F.col("n_chars").cast("double"), 0.0, 10000.0).alias("n")).select("lang", "y", (F.col("n") / 10000).alias("p"))


@query(f"""WITH {_SCORED}, g AS (SELECT lang, threshold, count(*) FILTER (y = 1) AS ta, count(*) FILTER (p >= threshold) AS pa, count(*) FILTER (y = 1 AND p >= threshold) AS o, count(*) FILTER (y = 1 OR p >= threshold) AS u,
avg(p) FILTER (y = 1) AS mi, avg(p) FILTER (y <> 1) AS mo, max(p) FILTER (y = 1) AS xi, max(p) FILTER (y <> 1) AS xo FROM s, (SELECT unnest([0.05, 0.1, 0.3, 0.5])::DOUBLE AS threshold) GROUP BY ALL HAVING ta > 0)
SELECT lang, threshold, ta AS true_area, pa AS predicted_area, o AS overlap, u AS "union", round(mi, 6) AS mean_in, round(mo, 6) AS mean_out, round(xi, 6) AS max_in, round(xo, 6) AS max_out, (o > 0)::INTEGER AS found,
round(o / ta, 6) AS recall, round(CASE WHEN pa = 0 THEN 0 ELSE o / pa END, 6) AS precision, round(o / u, 6) AS iou, round(pa / ta, 6) AS area_ratio FROM g""")
def event_metrics(spark, sf):
    m = me.event_metrics(_scored(spark, sf), "lang", "p", "y", [0.05, 0.1, 0.3, 0.5])
    return _r(m, "mean_in", "mean_out", "max_in", "max_out", "recall", "precision", "iou", "area_ratio")


_CURVE = f"""{_SCORED}, b AS (SELECT p AS threshold, sum(y) AS k, count(*) AS c FROM s GROUP BY 1),
c AS (SELECT threshold, sum(k) OVER w AS tp, sum(c) OVER w AS n, sum(k) OVER () AS total FROM b WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
f AS (SELECT threshold, tp::BIGINT AS tp, n::BIGINT AS n, tp / n AS precision, tp / total AS recall FROM c),
h AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM f)"""


@query(f"WITH {_CURVE} SELECT round(threshold, 6) AS threshold, tp, n, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM h")
def pr_curve(spark, sf):
    return _r(me.pr_curve(_scored(spark, sf), "p", "y").drop("positives"), "threshold", "precision", "recall", "f1")


@query(f"WITH {_CURVE} SELECT round(sum(x), 6) AS average_precision FROM (SELECT precision * (recall - coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0)) AS x FROM h)")
def avg_precision(spark, sf):
    return _r(me.average_precision(me.pr_curve(_scored(spark, sf), "p", "y")), "average_precision")


@query(f"WITH {_SCORED} SELECT round(sum((x.p > z.p)::INTEGER + (x.p = z.p)::INTEGER / 2) / count(*), 6) AS roc_auc FROM (SELECT p FROM s WHERE y = 1) x, (SELECT p FROM s WHERE y = 0) z")
def roc_auc(spark, sf):
    return _r(me.roc_auc(_scored(spark, sf), "p", "y"), "roc_auc")


@query(f"WITH {_CURVE} SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM h ORDER BY h.f1 DESC, h.threshold LIMIT 1")
def best_f1(spark, sf):
    return _r(me.best_f1(me.pr_curve(_scored(spark, sf), "p", "y")), "threshold", "f1")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def ols_simple(spark, sf):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return _t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query("SELECT round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse, round(covar_pop(y, f) / (stddev_pop(y) * stddev_pop(f)), 6) AS corr FROM (SELECT l_extendedprice AS y, 1500 * l_quantity AS f FROM lineitem)")
def residual_metrics(spark, sf):
    d = _t(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("f"))
    return _r(me.residual_metrics(d, "y", "f"), "r2", "rmse", "corr")


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _features(spark, sf) -> DataFrame:
    return _t(spark, sf, "lineitem").select(F.array(*[F.col(c).cast("double") for c in _COLS]).alias("x"))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS i, {j}::BIGINT AS j, round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 6) AS g FROM lineitem" for i, a in enumerate(_COLS) for j, b in enumerate(_COLS)) + ")")
def standardised_gram(spark, sf):
    n, total, outer = la.gram(_features(spark, sf), "x")
    _, std, cov = la.moments(n, total, outer)
    z = cov / std[:, None] / std[None]
    return spark.createDataFrame([(i, j, round(float(z[i, j]), 6) + 0.0) for i in range(4) for j in range(4)], "i long, j long, g double")


@query("""WITH m AS (SELECT count(*) AS n, corr(l_quantity, l_discount) AS r, covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity) AS b1, covar_pop(l_discount, l_extendedprice) / stddev_pop(l_discount) AS b2 FROM lineitem)
SELECT 'l_quantity' AS feature, round((n * b1 * (n + 1) - n * r * n * b2) / ((n + 1) * (n + 1) - n * r * n * r), 4) AS coef FROM m UNION ALL SELECT 'l_discount', round((n * b2 * (n + 1) - n * r * n * b1) / ((n + 1) * (n + 1) - n * r * n * r), 4) FROM m""")
def ridge_fit(spark, sf):
    coef, _ = la.ridge(*la.gram(_features(spark, sf), "x"), [0, 2], [1], 1.0)
    return spark.createDataFrame([(_COLS[c], round(float(w), 4)) for c, w in zip((0, 2), coef[:, 0])], "feature string, coef double")


@query()
def pca_variance(spark, sf):
    b = la.pca(_t(spark, sf, "embeddings"), "embedding", 10)
    return spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(b.ratio)], "pc int, ratio double")


@query()
def pca_scores(spark, sf):
    e = _t(spark, sf, "embeddings")
    return la.project(e, "embedding", la.pca(e, "embedding", 4)).select("vec_id", "label", "s")


@query()
def lasso_path(spark, sf):
    sums = la.gram(_features(spark, sf), "x")
    rows = [(a, float((la.elastic_net(*sums, [0, 2, 3], 1, a) != 0).sum())) for a in (0.001, 0.01, 0.1, 0.5, 1.0)]
    return spark.createDataFrame(rows, "alpha double, selected double")


@query()
def logistic_probe(spark, sf):
    e = _t(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("y"))
    probe = la.logistic_probe(e, "embedding", "y")
    return la.probabilities(e, F.col("embedding").cast("array<double>"), probe).select("vec_id", "y", F.round("p", 6).alias("p"))


@query("SELECT split_part(p_brand, '#', 1) AS field, round(sum(abs(p_retailprice)), 4) AS importance FROM part GROUP BY 1")
def importance_by_field(spark, sf):
    named = _t(spark, sf, "part").select(F.concat(F.split("p_brand", "#")[0], F.format_string("_lev%02d", F.col("p_size"))).alias("name"), "p_retailprice")
    return ag.importance_by_field(named, "name", "p_retailprice").withColumn("importance", F.round("importance", 4))


@query("""WITH l AS (SELECT DISTINCT p_size AS level FROM part), n AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS i, greatest(1, count(*) OVER () // 3) AS t FROM l)
SELECT level, CASE WHEN i < t THEN 'lower' WHEN i < 2 * t THEN 'mid' ELSE 'upper' END AS band FROM n""")
def level_band(spark, sf):
    named = _t(spark, sf, "part").select(F.format_string("q_lev%02d", F.col("p_size")).alias("name"))
    return ag.level_bands(named.select(feature_level(F.col("name")).alias("level"), feature_field(F.col("name")).alias("field")), "level")


@query("SELECT event_type, round(greatest(quantile_cont(abs(value), 0.99), 1e-6), 6) AS limit_99 FROM events GROUP BY 1")
def colour_limit(spark, sf):
    return _t(spark, sf, "events").groupBy("event_type").agg(F.round(ag.colour_limit(F.col("value")), 6).alias("limit_99"))


@query("""SELECT event_id, (date_trunc('day', ts) + to_hours((round_even(hour(ts) / 6, 0) * 6)::BIGINT)) AS nearest, round(((hour(ts) + (event_id % 360) / 15.0) % 24), 6) AS solar,
CASE WHEN event_id % 100 < 24 THEN (event_id % 100) || 'h' WHEN event_id % 100 % 24 = 0 THEN (event_id % 100 // 24) || 'd' ELSE (event_id % 100 // 24) || 'd ' || (event_id % 100 % 24) || 'h' END AS lead FROM events""")
def time_functions(spark, sf):
    lead = (F.col("event_id") % 100).cast("long")
    return _t(spark, sf, "events").select("event_id", nearest_six_hours(F.col("ts")).cast("timestamp_ntz").alias("nearest"), F.round(solar_hour(F.col("ts"), F.col("event_id") % 360), 6).alias("solar"), lead_label(lead).alias("lead"))


@query("SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def time_range(spark, sf):
    return pf.between(_t(spark, sf, "events"), "ts", "2024-01-05", "2024-01-12")


@query("SELECT event_id FROM events WHERE ts::DATE IN (SELECT DISTINCT ts::DATE FROM events WHERE ts::DATE >= DATE '2024-01-10' ORDER BY 1 LIMIT 5)")
def first_days(spark, sf):
    return pf.first_days(_t(spark, sf, "events"), "ts", 5, "2024-01-10").select("event_id")


@query("WITH s AS (SELECT d, row_number() OVER (ORDER BY d) AS n, count(*) OVER () AS c FROM (SELECT DISTINCT ts::DATE AS d FROM events)) SELECT n <= greatest(1, floor(c * 0.8)) AS training, count(*) AS rows FROM events JOIN s ON d = ts::DATE GROUP BY 1")
def split_by_position(spark, sf):
    a, b = pf.split_by_position(_t(spark, sf, "events").withColumn("day", F.to_date("ts")), "day", 0.8)
    one = lambda df, t: df.agg(F.count("*").alias("rows")).select(F.lit(t).alias("training"), "rows")
    return one(a, True).unionAll(one(b, False))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE (k - 1) % 4 = 0")
def every_nth(spark, sf):
    e = _t(spark, sf, "events").withColumn("o", F.struct("ts", "event_id"))
    return pf.every_nth(e, ["user_id"], "o", 4).select("user_id", "event_id")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def last_by_time(spark, sf):
    return wi.first_last(_t(spark, sf, "events").withColumn("o", F.struct("ts", "event_id")), ["user_id"], "o", False).select("user_id", "event_id")


@query("SELECT label, count(*) AS rows, count(DISTINCT len(embedding)) AS widths, sum(len(list_filter(embedding, lambda v: isnan(v) OR isinf(v))))::BIGINT AS not_finite FROM embeddings GROUP BY 1")
def quality_report(spark, sf):
    return ag.quality_report(_t(spark, sf, "embeddings"), "label", "embedding")


@query("SELECT vec_id FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings WHERE len(list_filter(embedding, lambda v: isnan(v) OR isinf(v))) > 0)")
def complete_steps(spark, sf):
    return pf.complete_steps(_t(spark, sf, "embeddings"), "label", "embedding").select("vec_id")


@query()
def mesh_radius_mean(spark, sf):
    """Customers as points on the sphere, averaged onto the nodes of a mesh within 0.6 of its edge."""
    nodes = mesh_nodes(spark, 3)
    lat, lon = F.radians((F.col("c_custkey") * 37 % 1801) / 10.0 - 90), F.radians(F.col("c_custkey") * 101 % 3600 / 10.0)
    p = _t(spark, sf, "customer").select("c_custkey", "c_acctbal", (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))
    pairs = jn.radius_pairs(p, nodes, 0.6 * longest_edge(3), "c_custkey", "node").join(p.select("c_custkey", "c_acctbal"), "c_custkey")
    return _r(ag.radius_mean(pairs, nodes, "node", "c_acctbal"), "mean")


@query("SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def static_join(spark, sf):
    return _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std FROM orders GROUP BY ALL")
def mean_and_sample_std(spark, sf):
    return _t(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("std"))


@query("SELECT DISTINCT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 5")
def topk_in_group(spark, sf):
    o = _t(spark, sf, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    return o.filter("k <= 5").select("o_orderkey", "o_totalprice")


_HOLES = "h AS (SELECT vec_id, label, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 11 = 0 THEN 'NaN'::DOUBLE ELSE embedding[1]::DOUBLE END AS a, CASE WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN 'NaN'::DOUBLE ELSE embedding[2]::DOUBLE END AS b, 1.0::DOUBLE AS c FROM embeddings), g AS (SELECT * FROM h WHERE a IS NOT NULL AND NOT isnan(a) AND b IS NOT NULL AND NOT isnan(b))"


def _holes(spark, sf) -> DataFrame:
    """Two positions with planted nulls and NaN, and a constant."""
    e, n, at = _t(spark, sf, "embeddings"), F.col("vec_id"), lambda k: F.get("embedding", F.lit(k)).cast("double")
    hole = lambda null, nan, v: F.when(n % null == 0, F.lit(None)).when(n % nan == 0, F.lit(float("nan"))).otherwise(v)
    return e.select("vec_id", "label", hole(7, 11, at(0)).alias("a"), hole(5, 13, at(1)).alias("b"), F.lit(1.0).alias("c"))


@query(f"WITH {_HOLES}, r AS (SELECT label, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) AS r FROM g GROUP BY 1 HAVING count(*) >= 10) SELECT label, 'b' AS feature, round(r, 6) AS r, 1::BIGINT AS rank FROM r UNION ALL SELECT label, 'c', NULL, 2 FROM r")
def screen_with_missing(spark, sf):
    """Rows without one of the values count for no pair; the constant feature ranks last."""
    h = _holes(spark, sf)
    out = screen(h, ["label"], {"a": F.col("a")}, {"b": F.col("b"), "c": F.col("c")})
    return out.select("label", "feature", F.round("r", 6).alias("r"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_HOLES} SELECT label, round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) AS r FROM g GROUP BY 1")
def pearson_with_missing(spark, sf):
    return _holes(spark, sf).groupBy("label").agg(F.round(pearson(F.col("a"), F.col("b")), 6).alias("r"))


@query(f"WITH {_HOLES} SELECT round(1 - sum((a - b) * (a - b)) / (var_pop(a) * count(*)), 6) AS r2, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse, round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) AS corr FROM g")
def residuals_with_missing(spark, sf):
    return _r(me.residual_metrics(_holes(spark, sf), "a", "b"), "r2", "rmse", "corr")


@query(f"WITH {_R.format(step='a.label,')} SELECT component, feature, round(avg(r), 6) AS mean_corr, round(avg(abs(r)), 6) AS mean_abs, round(max(abs(r)), 6) AS max_abs, count(r) AS \"count\" FROM p GROUP BY ALL")
def correlation_summary(spark, sf):
    return _r(ag.correlation_summary(_screened(spark, sf, ["label"]), ["component", "feature"]), "mean_corr", "mean_abs", "max_abs")


@query("""WITH m AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_discount, l_extendedprice) AS b, corr(l_quantity, l_discount) AS c, stddev_pop(l_extendedprice) AS s FROM lineitem)
SELECT round((a - b * c) / (1 - c * c) * s, 4) AS beta_quantity, round((b - a * c) / (1 - c * c) * s, 4) AS beta_discount, round((a * a + b * b - 2 * a * b * c) / (1 - c * c), 6) AS r2 FROM m""")
def ols_several(spark, sf):
    w, r2 = la.ols(*la.gram(_features(spark, sf), "x"), [0, 2], 1)
    return spark.createDataFrame([(round(float(w[0]), 4), round(float(w[1]), 4), round(r2, 6))], "beta_quantity double, beta_discount double, r2 double")


def _halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    x = F.array(*[F.col(c).cast("double") for c in _COLS])
    rows = _t(spark, sf, "lineitem")
    return rows.filter("l_orderkey % 4 <> 0").select(x.alias("x")), rows.filter("l_orderkey % 4 = 0").select(x.alias("x"))


@query("""WITH t AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(l_extendedprice) AS my, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem WHERE l_orderkey % 4 <> 0),
f AS (SELECT l_extendedprice AS y, my + n * c / sx / (n + 1) * (l_quantity - mx) / sx AS f FROM lineitem, t WHERE l_orderkey % 4 = 0)
SELECT 'l_extendedprice' AS target, 1 AS n_features, round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) AS r2_test, round(sqrt(avg((y - f) * (y - f))), 4) AS rmse_test, round(corr(y, f), 6) AS corr_test FROM f""")
def ridge_grid_first(spark, sf):
    """The first cell of a grid of targets and numbers of features, trained and tested on other orders."""
    train, test = (la.gram(h, "x") for h in _halves(spark, sf))
    grid = la.fit_grid(train, test, [0, 2, 3], [1], [1], [1.0])
    return spark.createDataFrame([(_COLS[y], n, round(float(r2), 6), round(float(rmse), 4), round(float(c), 6)) for y, n, _, _, r2, rmse, c in grid], "target string, n_features int, r2_test double, rmse_test double, corr_test double")


@query()
def fit_grids(spark, sf):
    """Every position of the embeddings from the first 4, 8, 16 and 32 others, by ridge and lasso; the alpha with the best R2 on held-out rows."""
    e = _t(spark, sf, "embeddings")
    train, test = la.gram(e.filter("vec_id % 4 <> 0"), "embedding"), la.gram(e.filter("vec_id % 4 = 0"), "embedding")
    d = len(train[1])
    rows = []
    for kind, alphas in (("ridge", log_grid(-1, 3, 5)), ("lasso", log_grid(-3, 0, 4))):
        grid = la.fit_grid(train, test, list(range(d // 2)), list(range(d // 2, d)), [4, 8, 16, d // 2], alphas, kind)
        rows += [(kind, *map(float, r)) for r in la.best_alpha(grid)]
    return spark.createDataFrame(rows, "kind string, target double, n_features double, alpha double, selected double, r2 double, rmse double, corr double")


@query("""WITH c AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS quantity, corr(l_discount, l_extendedprice) AS discount, corr(l_tax, l_extendedprice) AS tax FROM lineitem GROUP BY 1)
SELECT l_returnflag, CASE WHEN abs(quantity) >= abs(discount) AND abs(quantity) >= abs(tax) THEN 'quantity' WHEN abs(discount) >= abs(tax) THEN 'discount' ELSE 'tax' END AS strongest,
round(CASE WHEN abs(quantity) >= abs(discount) AND abs(quantity) >= abs(tax) THEN quantity WHEN abs(discount) >= abs(tax) THEN discount ELSE tax END, 6) AS strongest_value FROM c""")
def strongest_predictor(spark, sf):
    c = _t(spark, sf, "lineitem").groupBy("l_returnflag").agg(*[pearson(F.col("l_" + k), F.col("l_extendedprice")).alias(k) for k in ("quantity", "discount", "tax")])
    return _r(ag.strongest(c, ["quantity", "discount", "tax"]), "strongest_value").select("l_returnflag", "strongest", "strongest_value")


_NAMED = "n AS (SELECT CASE WHEN p_size % 10 = 0 THEN split_part(p_brand, '#', 1) ELSE split_part(p_brand, '#', 1) || '_lev' || lpad(p_size::VARCHAR, 2, '0') END AS name, sum(p_retailprice) - 100000 AS coef FROM part GROUP BY 1)"


def _named(spark, sf) -> DataFrame:
    name = F.when(F.col("p_size") % 10 == 0, F.split("p_brand", "#")[0]).otherwise(F.concat(F.split("p_brand", "#")[0], F.format_string("_lev%02d", F.col("p_size"))))
    return _t(spark, sf, "part").groupBy(name.alias("name")).agg((F.sum("p_retailprice") - 100000).alias("coef"))


@query(f"WITH {_NAMED} SELECT name, round(coef, 4) AS coef, row_number() OVER (ORDER BY abs(coef) DESC, name) AS place FROM n")
def coefficient_ranking(spark, sf):
    return la.rank_coefficients(_named(spark, sf), "name", "coef").select("name", F.round("coef", 4).alias("coef"), F.col("place").cast("long").alias("place"))


@query(f"WITH {_NAMED} SELECT coalesce(try_cast(nullif(regexp_extract(name, '_lev([0-9]+)$', 1), '') AS INTEGER)::VARCHAR, 'static') AS level, round(sum(abs(coef)), 4) AS importance FROM n GROUP BY 1")
def importance_by_level(spark, sf):
    return ag.importance_by_level(_named(spark, sf), "name", "coef").withColumn("importance", F.round("importance", 4))


@query(f"""WITH {_NAMED}, v AS (SELECT *, try_cast(nullif(regexp_extract(name, '_lev([0-9]+)$', 1), '') AS INTEGER) AS level FROM n), l AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS i, greatest(1, count(*) OVER () // 3) AS t FROM (SELECT DISTINCT level FROM v WHERE level IS NOT NULL))
SELECT CASE WHEN i IS NULL THEN 'static' WHEN i < t THEN 'lower' WHEN i < 2 * t THEN 'mid' ELSE 'upper' END AS band, round(sum(abs(coef)), 4) AS importance FROM v LEFT JOIN l USING (level) GROUP BY 1""")
def importance_by_band(spark, sf):
    return ag.importance_by_band(_named(spark, sf), "name", "coef").withColumn("importance", F.round("importance", 4))


_METRICS = ORACLE_SQL["event_metrics"]


@query(f"SELECT threshold, round(avg(found), 5) AS mean_found, round(avg(recall), 5) AS mean_recall, round(avg(precision), 5) AS mean_precision, round(avg(iou), 5) AS mean_iou, round(avg(area_ratio), 4) AS mean_area_ratio, count(*) AS events FROM ({_METRICS}) GROUP BY 1")
def metrics_by_threshold(spark, sf):
    out = me.metrics_by_threshold(event_metrics(spark, sf)).withColumn("mean_area_ratio", F.round("mean_area_ratio", 4))
    return out.withColumns({c: F.round(c, 5) for c in ("mean_found", "mean_recall", "mean_precision", "mean_iou")})


@query(f"SELECT m.lang, m.threshold, m.recall, d.documents FROM ({_METRICS}) m LEFT JOIN (SELECT lang, count(*) AS documents FROM documents WHERE lang <> 'fr' GROUP BY 1) d ON m.lang = d.lang")
def metrics_with_metadata(spark, sf):
    meta = _t(spark, sf, "documents").filter("lang <> 'fr'").groupBy("lang").agg(F.count("*").alias("documents"))
    return me.with_metadata(event_metrics(spark, sf), meta, "lang").select("lang", "threshold", "recall", "documents")


@query("SELECT source, count(*) FILTER (toxic > 0) AS positives, count(toxic) AS cells, round(avg((toxic > 0)::INTEGER), 6) AS share FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def mask_stats(spark, sf):
    rows = jn.join_all(_t(spark, sf, "labels"), _t(spark, sf, "documents").select("doc_id", "source"), ["doc_id"])
    return _r(me.mask_stats(rows, "source", "toxic"), "share")


@query("SELECT lang, source, row_number() OVER (ORDER BY lang, source) - 1 AS event_number FROM (SELECT DISTINCT lang, source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def event_numbers(spark, sf):
    toxic = _t(spark, sf, "labels").filter("toxic = 1").join(_t(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    return wi.event_numbers(toxic.select("lang", "source").distinct(), ["lang", "source"]).select("lang", "source", F.col("event_number").cast("long").alias("event_number"))


@query("SELECT user_id, count(*) AS n, count(DISTINCT ts::DATE) AS days, count(DISTINCT event_type) AS kinds, sum((event_type = 'error')::INTEGER)::BIGINT AS positives, round(avg((event_type = 'error')::INTEGER), 6) AS rate FROM events GROUP BY 1")
def class_balance(spark, sf):
    e = _t(spark, sf, "events").withColumn("y", (F.col("event_type") == "error").cast("int"))
    counts = e.groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("days"), F.count_distinct("event_type").alias("kinds"))
    return _r(ag.class_balance(e, ["user_id"], "y"), "rate").join(counts, "user_id")


@query("SELECT min(n) AS min, median(n) AS median, max(n) AS max FROM (SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1)")
def neighbour_counts(spark, sf):
    nodes = _t(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    return ag.neighbour_counts(_t(spark, sf, "orders").select(F.col("o_custkey").alias("node")), nodes, "node")


@query("""WITH s AS (SELECT DISTINCT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS step FROM events), p AS (SELECT DISTINCT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS step FROM events WHERE event_type = 'purchase')
SELECT p.step FROM p JOIN s ON s.step BETWEEN p.step - INTERVAL 6 HOUR AND p.step + INTERVAL 48 HOUR GROUP BY 1 HAVING count(*) = 10""")
def forecast_windows(spark, sf):
    """Steps with a purchase of which the step before and all of the two days after are there."""
    e = _t(spark, sf, "events").select("event_type", F.window("ts", "6 hours")["start"].alias("step"))
    return jn.complete_windows(e.filter("event_type = 'purchase'"), e, "step", 1, 8)


_FIRST = """WITH p AS (SELECT DISTINCT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start FROM events WHERE event_type = 'signup'), m AS (SELECT DISTINCT ts FROM events WHERE event_type = 'error'),
c AS (SELECT start, step::INTEGER AS step, ts, row_number() OVER (PARTITION BY start, step ORDER BY abs(epoch_us(ts) - epoch_us(start) - step * 21600000000), ts) AS k FROM p, range(20) t(step), m WHERE abs(epoch_us(ts) - epoch_us(start) - step * 21600000000) <= 300000000)
SELECT start, arg_{end}(step, step) AS step, arg_{end}(ts, step) AS mark FROM c WHERE k = 1 GROUP BY 1"""


def _usable(spark, sf, backward: bool) -> DataFrame:
    e = _t(spark, sf, "events")
    starts = e.filter("event_type = 'signup'").select(F.window("ts", "6 hours")["start"].alias("start"))
    return jn.first_usable_step(starts, e.filter("event_type = 'error'").select(F.col("ts").alias("mark")), "start", "mark", 20, 300, backward=backward)


@query(_FIRST.format(end="min"))
def first_usable_step(spark, sf):
    return _usable(spark, sf, False)


@query(_FIRST.format(end="max"))
def last_usable_step(spark, sf):
    return _usable(spark, sf, True)


@query("""WITH d AS (SELECT ts::DATE AS day, list_sort(list(DISTINCT user_id)) AS u, count(*) AS rows, count(DISTINCT user_id) AS nodes FROM events GROUP BY 1)
SELECT day, nodes, rows FROM d WHERE u <> (SELECT arg_min(u, day) FROM d) OR rows <> nodes""")
def other_node_sets(spark, sf):
    return jn.other_node_sets(_t(spark, sf, "events").withColumn("day", F.to_date("ts")), "day", "user_id")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) <> 1995")
def outside_year(spark, sf):
    return pf.outside_year(_t(spark, sf, "orders"), "o_orderdate", 1995).select("o_orderkey")


@query("SELECT hour(ts)::INTEGER AS hour, ts < TIMESTAMP '2024-01-15' AS training, count(*) AS n FROM events WHERE hour(ts) IN (0, 6, 12, 18) GROUP BY ALL")
def hours_and_date_cut(spark, sf):
    parts = pf.before_and_from(pf.at_hours(_t(spark, sf, "events"), "ts", [0, 6, 12, 18]), "ts", "2024-01-15")
    one = lambda df, t: df.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n")).select("hour", F.lit(t).alias("training"), "n")
    return one(parts[0], True).unionAll(one(parts[1], False))


@query("SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE n.n_regionkey <= 2")
def up_to_level(spark, sf):
    nodes = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("first_level"), "n_name")
    rows = pf.up_to_level(_t(spark, sf, "supplier"), nodes, "s_nationkey", 2)
    return pf.by_level_map(rows, nodes, "s_nationkey").select("s_suppkey", "n_name")


@query("WITH r AS (SELECT l_suppkey, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem GROUP BY 1) SELECT l_suppkey, CASE WHEN r2 >= 0.9 THEN 'well' ELSE 'badly' END AS list FROM r WHERE r2 >= 0.9 OR r2 < 0.8")
def explained_and_not(spark, sf):
    r = _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.regr_r2("l_extendedprice", "l_quantity").alias("r2"))
    return pf.explained_and_not(r, "r2", 0.9, 0.8).select("l_suppkey", "list")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_linenumber = m")
def last_lead(spark, sf):
    return pf.select_leads(_t(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", "last").select("l_orderkey", "l_linenumber")


@query("""SELECT event_id, date_trunc('month', ts)::DATE AS month, (date_trunc('month', ts) + INTERVAL 1 MONTH)::DATE AS next, ts + to_hours((event_id % 100)::BIGINT) AS valid, round(sin((dayofyear(ts) - 1) * 2 * pi() / 365.25), 6) AS season, round(cos(hour(ts) * 2 * pi() / 24), 6) AS clock, 'PC_' || (event_id % 20) AS name FROM events""")
def calendar_functions(spark, sf):
    e, ts = _t(spark, sf, "events"), F.col("ts")
    first, following = month_bounds(ts)
    season, _, _, clock = season_angles(ts)
    return e.select("event_id", first.alias("month"), following.alias("next"), valid_time(ts, F.col("event_id") % 100).cast("timestamp_ntz").alias("valid"), F.round(season, 6).alias("season"), F.round(clock, 6).alias("clock"), component_name(F.col("event_id") % 20).alias("name"))


@query(f"WITH {_PAIRMEAN} SELECT ((b - a + 4) % 4)::INTEGER AS shift, round(avg(sim), 6) AS mean FROM m GROUP BY 1")
def diurnal_lag_curve(spark, sf):
    return _r(si.diurnal_lag_curve(_slots(spark, sf)), "mean")


def _streamed(spark, sf, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over the events has by its end."""
    schema = _t(spark, sf, "events").schema
    return st.run_through(make(spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))))


@query("SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1 HAVING count(*) <> 334")
def stream_daily_counts(spark, sf):
    return _streamed(spark, sf, lambda s: st.daily_counts(s, "ts", expected=334)).select(F.to_date("day").alias("day"), "n")


@query("""WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS new FROM events), s AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf):
    return _streamed(spark, sf, lambda s: st.sessions(s, "ts", "user_id", "6 hours")).select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")
