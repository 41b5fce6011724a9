"""Registered queries and their DuckDB twins. Floats are rounded alike on both sides; counts are exact."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import losses, metrics
from .operators import binning, order, profile, rows, splits, targets
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(c)


# Profile, kinds, markers, append, dictionaries

_NUMS = ("min", "q1", "median", "q3", "max", "mean")


def _profile_sql(source: str, numeric: list[str], categorical: list[str]) -> str:
    parts = []
    for c in numeric:
        parts.append(f"""SELECT '{c}' AS "column", 'numeric' AS kind, count(*) - count(v) AS missing, count(DISTINCT v) AS "distinct",
  round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q3,
  round(max(v), 4) AS max, round(avg(v), 4) AS mean,
  (SELECT count(*) FROM t, (SELECT quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b FROM t) WHERE b > a AND {c} < a - 3 * (b - a)) AS far_low,
  (SELECT count(*) FROM t, (SELECT quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b FROM t) WHERE b > a AND {c} > b + 3 * (b - a)) AS far_high
FROM (SELECT {c}::DOUBLE AS v FROM t)""")
    for c in categorical:
        none = ", ".join(f"NULL::DOUBLE AS {n}" for n in _NUMS)
        parts.append(f"""SELECT '{c}' AS "column", 'categorical' AS kind, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "distinct", {none}, 0::BIGINT AS far_low, 0::BIGINT AS far_high FROM t""")
    return f"WITH t AS ({source})\n" + "\nUNION ALL\n".join(parts)


def _profiled(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    p = profile.profile(df, numeric, categorical)
    return p.select("column", "kind", "missing", "distinct", *(_r(c, 4) for c in _NUMS), "far_low", "far_high")


_HOLES = "SELECT event_id, CASE WHEN event_id % 10 < 3 THEN NULL WHEN event_id % 97 = 0 THEN value * 100 ELSE value END AS value, user_id, event_type FROM events"


@query("profile_orders", _profile_sql("SELECT * FROM orders", ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"]))
def profile_orders(spark, sf):
    return _profiled(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("profile_events_holes", _profile_sql(_HOLES, ["value", "user_id"], ["event_type"]))
def profile_events_holes(spark, sf):
    e = table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 10 < 3, None).when(F.col("event_id") % 97 == 0, F.col("value") * 100).otherwise(F.col("value")))
    return _profiled(e, ["value", "user_id"], ["event_type"])


@query("profile_summary", """WITH c AS (SELECT count(*) AS n, count(*) - count(o_totalprice) + count(*) - count(o_orderstatus) AS m, count(DISTINCT o_totalprice) AS a, count(DISTINCT o_orderstatus) AS b FROM orders)
SELECT 2 * n AS cells, round(m / (2.0 * n), 6) AS missing_share, (a = 0)::BIGINT + (b = 0)::BIGINT AS empty, (a = 1)::BIGINT + (b = 1)::BIGINT AS constant, (b >= 256)::BIGINT AS wide FROM c""")
def profile_summary(spark, sf):
    o = table(spark, sf, "orders")
    stats = profile.profile(o, ["o_totalprice"], ["o_orderstatus"])
    n = o.agg(F.count("*").alias("__n"))
    s = stats.join(F.broadcast(n))
    return s.agg(F.sum("__n").alias("cells"), F.round(F.sum("missing") / F.sum("__n"), 6).alias("missing_share"), F.count(F.when(F.col("distinct") == 0, 1)).alias("empty"), F.count(F.when(F.col("distinct") == 1, 1)).alias("constant"), F.count(F.when((F.col("kind") == "categorical") & (F.col("distinct") >= 256), 1)).alias("wide"))


_NUMBER_SQL = r"regexp_matches(trim(v, ' ' || chr(9) || chr(13) || chr(10)), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')"
_MARK_SQL = "(v IS NULL OR lower(trim(v, ' ' || chr(9) || chr(13) || chr(10))) IN ('', 'na', 'n/a', '#n/a', 'nan', 'null', 'none', 'nil', '?'))"


@query("sniff_kinds", f"""WITH t AS (SELECT o_orderkey, unnest(['price', 'status', 'cust', 'late']) AS "column",
  unnest([CASE WHEN o_orderkey % 5 = 0 THEN 'NA' ELSE CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) END, o_orderstatus, CAST(o_custkey AS VARCHAR), CASE WHEN o_orderkey > 1200 THEN 'oops' ELSE '1' END]) AS v FROM orders)
SELECT "column", CASE WHEN bool_and({_MARK_SQL} OR {_NUMBER_SQL}) THEN 'numeric' ELSE 'categorical' END AS kind FROM t WHERE o_orderkey < 1000 GROUP BY "column" """)
def sniff_kinds(spark, sf):
    o = table(spark, sf, "orders")
    text = o.select(F.col("o_orderkey").alias(tables.ROW), F.when(F.col("o_orderkey") % 5 == 0, "NA").otherwise(F.round("o_totalprice").cast("long").cast("string")).alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("string").alias("cust"), F.when(F.col("o_orderkey") > 1200, "oops").otherwise("1").alias("late"))
    return tables.sniff(text, ["price", "status", "cust", "late"])


_RAW_SQL = "CASE event_id % 9 WHEN 0 THEN 'NA' WHEN 1 THEN ' nan ' WHEN 2 THEN '' WHEN 3 THEN 'N/A' WHEN 4 THEN 'None' WHEN 5 THEN ' ? ' WHEN 6 THEN 'oops' WHEN 7 THEN ' 1.5e1 ' ELSE '2d' END"


@query("marker_missing", f"""WITH t AS (SELECT event_type, {_RAW_SQL} AS v FROM events)
SELECT event_type, count(*) FILTER ({_MARK_SQL}) AS missing, count(*) FILTER (NOT {_MARK_SQL} AND NOT {_NUMBER_SQL}) AS unparsed, coalesce(sum(CASE WHEN {_NUMBER_SQL} THEN TRY_CAST(trim(v) AS DOUBLE) END), 0) AS total FROM t GROUP BY event_type""")
def marker_missing(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.expr(_RAW_SQL).alias("v"))
    v = F.col("v")
    return e.groupBy("event_type").agg(F.count(F.when(tables.is_missing(v), 1)).alias("missing"), F.count(F.when(~tables.is_missing(v) & tables.as_number(v).isNull(), 1)).alias("unparsed"), F.coalesce(F.sum(tables.as_number(v)), F.lit(0.0)).alias("total"))


@query("append_extra", """SELECT o_orderkey % 4 = 0 AS is_extra, o_orderstatus, count(*) AS n, count(CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END) AS n_price FROM orders GROUP BY 1, 2""")
def append_extra(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", tables.ROW)
    kinds = {"o_totalprice": "numeric", "o_orderstatus": "categorical"}
    main = tables.Frame(o.where(f"{tables.ROW} % 4 != 0").select(tables.ROW, *kinds), kinds)
    extra = tables.Frame(o.where(f"{tables.ROW} % 4 = 0").select(tables.ROW, "o_orderstatus"), {"o_orderstatus": "categorical"})
    both = tables.append(main, extra, {"o_totalprice"}).df
    return both.groupBy("is_extra", "o_orderstatus").agg(F.count("*").alias("n"), F.count("o_totalprice").alias("n_price"))


@query("dictionary_first_seen", "SELECT o_orderpriority AS level, row_number() OVER (ORDER BY min(o_orderkey), o_orderpriority) - 1 AS id FROM orders GROUP BY o_orderpriority")
def dictionary_first_seen(spark, sf):
    return tables.dictionary(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey")


# Labels, weights, hold-outs, folds, sampling

@query("label_encode_sorted", "SELECT event_type AS class, row_number() OVER (ORDER BY event_type) - 1 AS index FROM events GROUP BY event_type")
def label_encode_sorted(spark, sf):
    return rows.encode_labels(table(spark, sf, "events"), "event_type")


@query("class_weights_balanced", "SELECT event_type AS class, round(sum(sum(value)) OVER () / (count(*) OVER () * sum(value)), 6) AS weight FROM events GROUP BY event_type")
def class_weights_balanced(spark, sf):
    return rows.class_weights(table(spark, sf, "events"), "event_type", "value").select("class", _r("weight"))


@query("holdout_exact_k", """SELECT o_orderkey, row_number() OVER (ORDER BY md5('1|' || o_orderkey), o_orderkey) <= round(count(*) OVER () * 0.2) AS is_valid FROM orders""")
def holdout_exact_k(spark, sf):
    return rows.holdout(table(spark, sf, "orders"), ["o_orderkey"], 0.2).select("o_orderkey", "is_valid")


@query("split_col", "SELECT coalesce(CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE (o_custkey % 4) / 4.0 END >= 0.5, false) AS is_valid, count(*) AS n FROM orders GROUP BY 1")
def split_col(spark, sf):
    c = F.when(F.col("o_custkey") % 7 == 0, None).otherwise((F.col("o_custkey") % 4) / 4.0)
    return table(spark, sf, "orders").select(rows.split_column(c).alias("is_valid")).groupBy("is_valid").agg(F.count("*").alias("n"))


@query("folds_stratified", "SELECT o_orderkey, ((row_number() OVER (ORDER BY (o_orderstatus = 'F')::INT DESC, md5('1|' || o_orderkey), o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def folds_stratified(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("double"))
    return rows.folds(o, ["o_orderkey"], 5, 1, "y").select("o_orderkey", "fold")


@query("folds_plain", "SELECT o_orderkey, ((row_number() OVER (ORDER BY md5('3|' || o_orderkey), o_orderkey) - 1) % 4)::INT AS fold FROM orders")
def folds_plain(spark, sf):
    return rows.folds(table(spark, sf, "orders"), ["o_orderkey"], 4, 3).select("o_orderkey", "fold")


@query("es_slice", f"SELECT o_orderkey, (row_number() OVER (ORDER BY (o_orderstatus = 'F')::INT DESC, md5('{1 ^ 0x5EED}|' || o_orderkey), o_orderkey) - 1) % 10 = 0 AS is_stop FROM orders")
def es_slice(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("double"))
    return rows.stop_slice(o, ["o_orderkey"], 1, "y").select("o_orderkey", "is_stop")


@query("folds_grouped")
def folds_grouped(spark, sf):
    return rows.grouped_folds(table(spark, sf, "events"), "user_id", 5).select("event_id", "user_id", "fold")


@query("sample_rows", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('9|' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= least(n, greatest(1, round(n * 0.15)))")
def sample_rows(spark, sf):
    return rows.sample_rows(table(spark, sf, "orders"), ["o_orderkey"], 0.15, 9).select("o_orderkey")


@query("goss_select", """WITH m AS (SELECT avg(value) AS m, count(*) AS n FROM events),
r AS (SELECT event_id, m.m - value AS g, m.n AS n, row_number() OVER (ORDER BY abs(round(m.m - value, 6)) DESC, event_id) AS pos FROM events, m),
t AS (SELECT *, pos <= round(n * 0.2) AS is_top FROM r),
q AS (SELECT *, row_number() OVER (PARTITION BY is_top ORDER BY md5('4|' || event_id), event_id) AS lot FROM t)
SELECT event_id, is_top, round(CASE WHEN is_top THEN g ELSE g * 8.0::DOUBLE END, 4) AS g FROM q WHERE is_top OR lot <= round(n * 0.1)""")
def goss_select(spark, sf):
    e = table(spark, sf, "events")
    m = e.agg(F.avg("value").alias("m"))
    d = e.join(F.broadcast(m)).select("event_id", (F.col("m") - F.col("value")).alias("g"), F.lit(1.0).alias("h"))
    return rows.goss(d, ["event_id"], F.abs(F.round("g", 6)), 0.2, 0.1, 4).select("event_id", "is_top", _r("g", 4))


_U = "((('0x' || substr(md5('5|' || o_orderkey), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


@query("bootstrap_bernoulli", f"SELECT o_orderkey, CASE WHEN {_U} < 0.66::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w FROM orders")
def bootstrap_bernoulli(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", rows.bootstrap_weight("bernoulli", ["o_orderkey"], 5).alias("w"))


@query("bootstrap_bayesian", f"SELECT o_orderkey, round(pow(-ln({_U}), 0.5::DOUBLE), 6) AS w FROM orders")
def bootstrap_bayesian(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(rows.bootstrap_weight("bayesian", ["o_orderkey"], 5, temperature=0.5), 6).alias("w"))


@query("mvs_threshold", """WITH t AS (SELECT event_id // 1024 AS block, value, row_number() OVER w AS pos, sum(value) OVER (PARTITION BY event_id // 1024 ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS below,
  count(*) OVER (PARTITION BY event_id // 1024) AS n, lead(value) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY event_id // 1024 ORDER BY value, event_id)),
m AS (SELECT *, CASE WHEN n * 0.4::DOUBLE > n - pos THEN below / (n * 0.4::DOUBLE - (n - pos)) END AS mu FROM t)
SELECT block, round(min(CASE WHEN mu >= value AND (nxt IS NULL OR mu <= nxt) THEN mu END), 4) AS mu FROM m GROUP BY block""")
def mvs_threshold(spark, sf):
    e = table(spark, sf, "events").select(F.expr("event_id div 1024").alias("block"), "value")
    return rows.mvs_threshold(e, "block", "value", 0.4).select("block", _r("mu", 4))


# Bins

@query("bins_per_value", "WITH r AS (SELECT l_quantity, dense_rank() OVER (ORDER BY l_quantity) AS bin FROM lineitem) SELECT bin::INT AS bin, count(*) AS n FROM r GROUP BY 1")
def bins_per_value(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity")
    schema = binning.fit_schema(li, {"l_quantity": "numeric"})
    return binning.apply_schema(li, schema).groupBy(F.col("b_l_quantity").alias("bin")).agg(F.count("*").alias("n"))


@query("bins_uniform", """WITH m AS (SELECT min(value) AS a, (max(value) - min(value)) / 16 AS w FROM events),
e AS (SELECT (a + w * i)::FLOAT::DOUBLE AS edge FROM m, range(1, 16) t(i))
SELECT bin, count(*) AS n FROM (SELECT (1 + (SELECT count(*) FROM e WHERE edge < value))::INT AS bin FROM events) GROUP BY bin""")
def bins_uniform(spark, sf):
    e = table(spark, sf, "events").select("value")
    schema = binning.fit_schema(e, {"value": "numeric"}, binning.BinParams("uniform", max_bin=17))
    return binning.apply_schema(e, schema).groupBy(F.col("b_value").alias("bin")).agg(F.count("*").alias("n"))


@query("bins_quantile", """WITH r AS (SELECT value AS v, count(*) AS c FROM events GROUP BY value),
s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, sum(c) OVER (ORDER BY v) AS cum, sum(c) OVER (ORDER BY v) - c AS start, lag(v) OVER (ORDER BY v) AS prev FROM r),
k AS (SELECT 2 * k * (SELECT max(cum) FROM s)::DOUBLE / 15 AS rank2 FROM range(1, 15) t(k)),
q AS (SELECT rank2, (SELECT count(*) FROM s WHERE i >= 1 AND start + cum <= rank2) AS q FROM k),
c AS (SELECT CASE WHEN rank2 < 2 * s.cum THEN q ELSE q + 1 END AS c FROM q JOIN s ON s.i = q.q),
e AS (SELECT ((prev::FLOAT + v::FLOAT) * 0.5::FLOAT)::FLOAT::DOUBLE AS edge FROM s JOIN c ON s.i = c.c)
SELECT bin, count(*) AS n FROM (SELECT (1 + (SELECT count(*) FROM e WHERE edge < value))::INT AS bin FROM events) GROUP BY bin""")
def bins_quantile(spark, sf):
    e = table(spark, sf, "events").select("value")
    schema = binning.fit_schema(e, {"value": "numeric"}, binning.BinParams("quantile", max_bin=16))
    return binning.apply_schema(e, schema).groupBy(F.col("b_value").alias("bin")).agg(F.count("*").alias("n"))


def _policy(policy: str):
    def run(spark, sf):
        c = table(spark, sf, "customer").select("c_acctbal")
        schema = binning.fit_schema(c, {"c_acctbal": "numeric"}, binning.BinParams(policy, max_bin=17))
        return binning.apply_schema(c, schema).groupBy(F.col("b_c_acctbal").alias("bin")).agg(F.count("*").alias("n"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))

    return run


QUERIES["bins_greedy"], QUERIES["bins_logsum"] = _policy("greedy"), _policy("logsum")
ORACLE_SQL["bins_logsum"] = """WITH RECURSIVE r AS (SELECT c_acctbal AS v, count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1),
runs AS (SELECT v, sum(n) OVER (ORDER BY v) AS cum, sum(n) OVER (ORDER BY v) - n AS st, lead(v) OVER (ORDER BY v) AS nxt, row_number() OVER (ORDER BY v) AS i FROM r),
l AS (SELECT list(cum::DOUBLE ORDER BY i) AS cums, list(st::DOUBLE ORDER BY i) AS sts, count(*)::INT AS runs FROM runs),
segs AS (
  SELECT 0 AS step, 0 AS a, runs AS z FROM l
  UNION ALL
  SELECT step + 1, CASE WHEN rn = 1 AND side = 1 THEN s ELSE a END, CASE WHEN rn = 1 AND side = 0 THEN s ELSE z END
  FROM (SELECT *, row_number() OVER (ORDER BY gain DESC, a, z) AS rn, max(gain) OVER () AS top FROM (
    SELECT step, a, z, CASE WHEN mid > a AND mid < z AND (mid + 1 >= z OR g1 >= g2) THEN mid ELSE mid + 1 END AS s,
           CASE WHEN mid > a AND mid < z AND (mid + 1 >= z OR g1 >= g2) THEN g1 WHEN mid + 1 < z THEN g2 ELSE '-inf'::DOUBLE END AS gain FROM (
      SELECT *, ln(sts[mid + 1] - lo + 1e-8) + ln(hi - sts[mid + 1] + 1e-8) - ln(hi - lo + 1e-8) AS g1,
             CASE WHEN mid + 2 <= runs THEN ln(sts[mid + 2] - lo + 1e-8) + ln(greatest(hi - sts[mid + 2], 0) + 1e-8) - ln(hi - lo + 1e-8) END AS g2 FROM (
        SELECT step, a, z, cums, sts, runs, sts[a + 1] AS lo, cums[z] AS hi, len(list_filter(cums, lambda x: x < (sts[a + 1] + cums[z]) / 2))::INT AS mid FROM segs, l)))),
    (VALUES (0), (1)) k(side)
  WHERE step < 15 AND top > '-inf'::DOUBLE AND (rn = 1 OR side = 0)),
e AS (SELECT ((v::FLOAT + nxt::FLOAT) * 0.5::FLOAT)::FLOAT::DOUBLE AS edge FROM runs JOIN segs ON runs.i = segs.a WHERE step = (SELECT max(step) FROM segs) AND a > 0)
SELECT bin, count(*) AS n, min(v) AS lo, max(v) AS hi FROM (SELECT (1 + (SELECT count(*) FROM e WHERE edge < c_acctbal))::INT AS bin, c_acctbal AS v FROM customer) GROUP BY bin"""
ORACLE_SQL["bins_greedy"] = """WITH RECURSIVE r AS (SELECT c_acctbal AS v, count(*) AS n, CASE WHEN c_acctbal <= -1e-35 THEN -1 WHEN c_acctbal > 1e-35 THEN 1 ELSE 0 END AS side FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1),
runs AS (SELECT *, lead(v) OVER (ORDER BY v) AS nxt, row_number() OVER (PARTITION BY side ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY side) AS k FROM r),
share AS (SELECT coalesce(sum(n) FILTER (side < 0), 0) AS below, coalesce(sum(n) FILTER (side > 0), 0) AS above FROM r),
left_bins AS (SELECT -1 AS side, greatest(1, floor(below / (below + above) * 15))::INT AS bins FROM share WHERE below > 0),
sides AS (SELECT side, greatest(1, least(bins, total // 3)) AS bins, runs, total, cums, ns, bins AS given FROM (
    SELECT side, sum(n) AS total, count(*)::INT AS runs, list(n ORDER BY v) AS ns, list(cum ORDER BY v) AS cums FROM (SELECT side, v, n, sum(n) OVER (PARTITION BY side ORDER BY v) AS cum FROM r) GROUP BY side) JOIN left_bins USING (side)),
lefts AS (
  SELECT side, 0 AS k, 0 AS first, 0::DOUBLE AS base, bins AS open, total / bins::DOUBLE AS share, -1 AS cut FROM sides WHERE given > 1 AND runs > given
  UNION ALL
  SELECT side, k + 1, e + 1, cums[e + 1]::DOUBLE, open - 1, (total - cums[e + 1]) / nullif(open - 1, 0)::DOUBLE, e FROM (
    SELECT s.*, l.k, l.open, greatest(l.first, len(list_filter(s.cums, lambda x: x < l.base + l.share)))::INT AS e FROM lefts l JOIN sides s USING (side))
  WHERE k < bins - 1 AND e < runs - 1),
right_bins AS (SELECT 1 AS side, 15 - (SELECT count(*) FROM lefts WHERE cut >= 0) - (SELECT (below > 0)::INT FROM share) AS bins),
right_ AS (SELECT side, greatest(1, least(bins, total // 3)) AS bins, runs, total, cums, bins AS given FROM (
    SELECT side, sum(n) AS total, count(*)::INT AS runs, list(cum ORDER BY v) AS cums FROM (SELECT side, v, n, sum(n) OVER (PARTITION BY side ORDER BY v) AS cum FROM r) GROUP BY side) JOIN right_bins USING (side)),
rights AS (
  SELECT side, 0 AS k, 0 AS first, 0::DOUBLE AS base, bins AS open, total / bins::DOUBLE AS share, -1 AS cut FROM right_ WHERE given > 1 AND runs > given
  UNION ALL
  SELECT side, k + 1, e + 1, cums[e + 1]::DOUBLE, open - 1, (total - cums[e + 1]) / nullif(open - 1, 0)::DOUBLE, e FROM (
    SELECT s.*, l.k, l.open, greatest(l.first, len(list_filter(s.cums, lambda x: x < l.base + l.share)))::INT AS e FROM rights l JOIN right_ s USING (side))
  WHERE k < bins - 1 AND e < runs - 1),
cuts AS (SELECT side, cut FROM lefts WHERE cut >= 0 UNION SELECT side, cut FROM rights WHERE cut >= 0 UNION SELECT side, (k - 1)::INT FROM runs WHERE side < 1),
e AS (SELECT ((v::FLOAT + nxt::FLOAT) * 0.5::FLOAT)::FLOAT::DOUBLE AS edge FROM runs JOIN cuts ON cuts.side = runs.side AND cuts.cut = runs.i WHERE nxt IS NOT NULL)
SELECT bin, count(*) AS n, min(v) AS lo, max(v) AS hi FROM (SELECT (1 + (SELECT count(*) FROM e WHERE edge < c_acctbal))::INT AS bin, c_acctbal AS v FROM customer) GROUP BY bin"""


@query("apply_schema", """WITH l AS (SELECT o_orderpriority AS level, row_number() OVER (ORDER BY min(o_orderkey)) AS bin FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT coalesce(bin, 0)::INT AS level_bin, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 + (o_totalprice > 50000)::INT + (o_totalprice > 150000)::INT END AS price_bin, count(*) AS n FROM orders LEFT JOIN l ON level = o_orderpriority GROUP BY 1, 2""")
def apply_schema(spark, sf):
    o = table(spark, sf, "orders")
    levels = [r["level"] for r in tables.dictionary(o.where("o_orderpriority != '5-LOW'"), "o_orderpriority", "o_orderkey").orderBy("id").collect()]
    schema = binning.BinSchema([binning.Feature("o_orderpriority", "categorical", levels=levels), binning.Feature("price", "numeric", edges=[50000.0, 150000.0])])
    d = binning.apply_schema(o.withColumn("price", F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_totalprice"))), schema)
    return d.groupBy(F.col("b_o_orderpriority").alias("level_bin"), F.col("b_price").alias("price_bin")).agg(F.count("*").alias("n"))


@query("bin_means", """WITH b AS (SELECT l_quantity AS v, 1 + (l_quantity > 10.5)::INT + (l_quantity > 25.5)::INT + (l_quantity > 60.5)::INT + (l_quantity > 70.5)::INT AS bin FROM lineitem)
SELECT i::INT AS bin, round(CASE i WHEN 0 THEN (SELECT avg(v) FROM b) ELSE coalesce((SELECT avg(v) FROM b WHERE bin = i), CASE i WHEN 4 THEN 65.5 WHEN 5 THEN 70.5 END) END, 6) AS mean FROM range(6) t(i)""")
def bin_means(spark, sf):
    f = binning.Feature("l_quantity", "numeric", edges=[10.5, 25.5, 60.5, 70.5])
    li = binning.apply_schema(table(spark, sf, "lineitem"), binning.BinSchema([f]))
    return binning.bin_means(li, f, "b_l_quantity").select("bin", _r("mean"))


# Losses

_Y = {"logistic": "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END", "softmax": "l_linenumber % 3"}
_RAW = "(l_discount * 20 - 0.7)"
_GRAD_SQL = {
    "logistic": ("2.0_UP * (1 / (1 + exp(-r)) - y)", "2.0_UP * greatest(1 / (1 + exp(-r)) * (1 - 1 / (1 + exp(-r))), 1e-6)"),
    "squared_error": ("r - y", "1.0"),
    "absolute_error": ("sign(r - y)", "1.0"),
    "quantile": ("CASE WHEN r >= y THEN 1 - 0.8::DOUBLE ELSE -0.8::DOUBLE END", "1.0"),
    "pseudo_huber": ("(r - y) / sqrt(1 + (r - y) * (r - y) / 4)", "4 / ((4 + (r - y) * (r - y)) * sqrt(1 + (r - y) * (r - y) / 4))"),
    "poisson": ("exp(r) - y", "exp(r + 0.7::DOUBLE)"),
}


def _gradient(kind: str, g: str, h: str) -> None:
    y = _Y.get(kind, "l_quantity / 10")
    up = "(CASE WHEN y > 0.5 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END)"
    sql = f"""WITH t AS (SELECT l_linestatus, ({y})::DOUBLE AS y, ({_RAW})::DOUBLE AS r, l_quantity AS w FROM lineitem)
SELECT l_linestatus, round(sum(w * ({g.replace('2.0_UP', up)})) / count(*), 4) AS g, round(sum(w * ({h.replace('2.0_UP', up)})) / count(*), 4) AS h FROM t GROUP BY 1"""

    @query(f"grad_{kind}", sql)
    def run(spark, sf):
        loss = losses.Loss(kind, scale_pos_weight=2.0, quantile_alpha=0.8, huber_slope=2.0)
        d = table(spark, sf, "lineitem").select("l_linestatus", F.expr(y).cast("double").alias("y"), F.expr(_RAW).alias("r"), F.col("l_quantity").alias("w"))
        dg, dh = losses.gradients(loss, F.col("r"), F.col("y"), F.col("w"))
        return d.groupBy("l_linestatus").agg(F.round(F.sum(dg) / F.count("*"), 4).alias("g"), F.round(F.sum(dh) / F.count("*"), 4).alias("h"))


for _k, (_g, _h) in _GRAD_SQL.items():
    _gradient(_k, _g, _h)


@query("grad_softmax", """WITH t AS (SELECT l_linenumber % 3 AS y, l_quantity AS w, exp(l_discount) AS a, exp(l_tax) AS b, exp(0.02::DOUBLE) AS c FROM lineitem),
p AS (SELECT y, w, unnest([0, 1, 2]) AS class, unnest([a, b, c]) / (a + b + c) AS p FROM t)
SELECT class, round(sum((p - (y = class)::INT) * w) / count(*), 4) AS g, round(sum(greatest(2 * p * (1 - p) * w, 1e-16)) / count(*), 4) AS h FROM p GROUP BY class""")
def grad_softmax(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("y", F.col("l_linenumber") % 3)
    pairs = losses.softmax_gradients(losses.Loss("softmax", num_class=3), [F.col("l_discount"), F.col("l_tax"), F.lit(0.02)], F.col("y"), F.col("l_quantity"))
    long = d.select(F.explode(F.array(*(F.struct(F.lit(c).alias("class"), g.alias("g"), h.alias("h")) for c, (g, h) in enumerate(pairs)))).alias("x")).select("x.*")
    return long.groupBy("class").agg(F.round(F.sum("g") / F.count("*"), 4).alias("g"), F.round(F.sum("h") / F.count("*"), 4).alias("h"))


@query("base_scores", """WITH t AS (SELECT l_quantity / 10 AS y, (l_returnflag = 'R')::INT AS z FROM lineitem),
c AS (SELECT l_linenumber % 3 AS class, ln(count(*)) AS l FROM lineitem GROUP BY 1)
SELECT 'logistic' AS objective, round(ln(avg(z) / (1 - avg(z))), 6) AS score FROM t
UNION ALL SELECT 'squared_error', round(avg(y), 6) FROM t UNION ALL SELECT 'pseudo_huber', round(avg(y), 6) FROM t
UNION ALL SELECT 'absolute_error', round(quantile_cont(y, 0.5), 6) FROM t UNION ALL SELECT 'quantile', round(quantile_cont(y, 0.8), 6) FROM t
UNION ALL SELECT 'poisson', round(ln(avg(y)), 6) FROM t
UNION ALL SELECT 'softmax_' || class, round(l - (SELECT avg(l) FROM c), 6) FROM c""")
def base_scores(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_quantity") / 10).alias("y"), (F.col("l_returnflag") == "R").cast("double").alias("z"), (F.col("l_linenumber") % 3).alias("c"))
    parts = [losses.base_score(d, losses.Loss(k, quantile_alpha=0.8 if k == "quantile" else 0.5), "z" if k == "logistic" else "y").select(F.lit(k).alias("objective"), _r("score")) for k in losses.OBJECTIVES if k != "softmax"]
    parts.append(losses.base_score(d, losses.Loss("softmax", num_class=3), "c").select(F.concat(F.lit("softmax_"), F.col("class")).alias("objective"), _r("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Histograms and splits

_FEATURES = ["q", "d", "t", "l"]
_BINNED = """SELECT CASE WHEN l_partkey % 10 = 0 THEN 0 ELSE l_quantity::INT END AS q, (1 + round(l_discount * 100))::INT AS d, (1 + round(l_tax * 100))::INT AS t,
  CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber END AS l, (l_returnflag = 'R')::INT AS y, (l_linestatus = 'O')::INT + 1 AS node FROM lineitem"""
_LONG = "SELECT unnest(['q', 'd', 't', 'l']) AS feature, unnest([q, d, t, l])::INT AS bin, y, node FROM b"


def _binned(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.when(F.col("l_partkey") % 10 == 0, 0).otherwise(F.col("l_quantity").cast("int")).alias("q"), (1 + F.round(F.col("l_discount") * 100)).cast("int").alias("d"), (1 + F.round(F.col("l_tax") * 100)).cast("int").alias("t"), F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_linenumber")).alias("l"), (F.col("l_returnflag") == "R").cast("int").alias("y"), ((F.col("l_linestatus") == "O").cast("int") + 1).cast("long").alias("node"))


def _counts() -> dict[str, Column]:
    return {"n": F.lit(1).cast("long"), "pos": F.col("y").cast("long")}



@query("hist_root", f"WITH b AS ({_BINNED}), x AS ({_LONG}) SELECT feature, bin, count(*) AS n, sum(y)::BIGINT AS pos FROM x GROUP BY 1, 2")
def hist_root(spark, sf):
    return splits.histogram(_binned(spark, sf), _FEATURES, _counts())


@query("hist_level", f"WITH b AS ({_BINNED}), x AS ({_LONG}) SELECT node::BIGINT AS node, feature, bin, count(*) AS n, sum(y)::BIGINT AS pos FROM x GROUP BY 1, 2, 3")
def hist_level(spark, sf):
    return splits.histogram(_binned(spark, sf), _FEATURES, _counts(), ["node"])


@query("hist_subtract", f"WITH b AS ({_BINNED}), x AS ({_LONG}) SELECT feature, bin, count(*) FILTER (node = 2) AS n, coalesce(sum(y) FILTER (node = 2), 0)::BIGINT AS pos FROM x GROUP BY 1, 2")
def hist_subtract(spark, sf):
    b = _binned(spark, sf)
    return splits.subtract(splits.histogram(b, _FEATURES, _counts()), splits.histogram(b.where("node = 1"), _FEATURES, _counts()), ["n", "pos"], ["feature", "bin"])


def _with_gradients(hist: DataFrame, feature: str) -> DataFrame:
    """Logistic gradients at the base rate follow from counts alone."""
    rate = hist.where(F.col("feature") == feature).agg((F.sum("pos") / F.sum("n")).alias("p"))
    d = hist.join(F.broadcast(rate))
    return d.withColumn("g", F.col("n") * F.col("p") - F.col("pos")).withColumn("h", F.col("n") * F.col("p") * (1 - F.col("p"))).drop("p")


_SPLIT_SQL = f"""WITH b AS ({_BINNED}), x AS ({_LONG}), hist AS (SELECT feature, bin, count(*) AS n, sum(y)::BIGINT AS pos FROM x {{where}} GROUP BY 1, 2),
r AS (SELECT (sum(pos) / sum(n))::DOUBLE AS p FROM hist WHERE feature = 'd'),
c AS (SELECT feature, bin, sum(n) OVER w AS ln, sum(pos) OVER w AS lp, sum(n) OVER f AS tn, sum(pos) OVER f AS tp,
  coalesce(sum(CASE WHEN bin = 0 THEN n END) OVER f, 0) AS mn, coalesce(sum(CASE WHEN bin = 0 THEN pos END) OVER f, 0) AS mp
  FROM hist WINDOW w AS (PARTITION BY feature ORDER BY bin), f AS (PARTITION BY feature)),
s AS (SELECT feature, bin, tn, tp, unnest(CASE WHEN bin = 0 THEN [true] WHEN mn > 0 THEN [true, false] ELSE [ln >= tn - ln] END) AS missing_left, ln, lp, mn, mp FROM c),
m AS (SELECT feature, bin, missing_left, tn, tp, CASE WHEN missing_left THEN ln ELSE ln - mn END AS ln, CASE WHEN missing_left THEN lp ELSE lp - mp END AS lp FROM s),
g AS (SELECT feature, bin AS threshold, missing_left, ln AS n_left, (tn - ln) AS rn,
  (ln * p - lp) AS lg, ln * p * (1 - p) AS lh, ((tn - ln) * p - (tp - lp)) AS rg, (tn - ln) * p * (1 - p) AS rh, tn * p - tp AS tg, tn * p * (1 - p) AS th FROM m, r),
a AS (SELECT feature, threshold, missing_left, n_left::BIGINT AS n_left, lg * lg / (lh + 1) + rg * rg / (rh + 1) - tg * tg / (th + 1) AS gain FROM g WHERE n_left >= 20 AND rn >= 20 AND lh >= 1 AND rh >= 1)
"""


@query("best_split_numeric", _SPLIT_SQL.replace("{where}", "WHERE feature IN ('d', 't')") + "SELECT feature, threshold, missing_left, round(gain, 6) AS gain, n_left FROM a WHERE gain > 0")
def best_split_numeric(spark, sf):
    """Every admissible split of two features, with its gain."""
    hist = _with_gradients(splits.histogram(_binned(spark, sf), ["d", "t"], _counts()), "d")
    return splits.numeric_splits(hist, splits.SplitParams()).select("feature", "threshold", "missing_left", _r("gain"), "n_left")


@query("best_split_missing", _SPLIT_SQL.replace("{where}", "") + "SELECT feature, threshold, missing_left, round(gain, 6) AS gain, n_left FROM a WHERE gain > 0 ORDER BY round(gain, 9) DESC, feature, threshold, missing_left DESC LIMIT 1")
def best_split_missing(spark, sf):
    hist = _with_gradients(splits.histogram(_binned(spark, sf), _FEATURES, _counts()), "d")
    found = splits.numeric_splits(hist, splits.SplitParams())
    return splits.best(found, ["feature", "threshold", (~F.col("missing_left"))]).select("feature", "threshold", "missing_left", _r("gain"), "n_left")


@query("best_split_onehot", f"""WITH b AS ({_BINNED}), hist AS (SELECT l AS bin, count(*) AS n, sum(y)::BIGINT AS pos FROM b GROUP BY 1),
t AS (SELECT sum(n) AS tn, sum(pos) AS tp, (sum(pos) / sum(n))::DOUBLE AS p FROM hist),
g AS (SELECT bin AS level, n AS n_left, tn - n AS rn, n * p - pos AS lg, n * p * (1 - p) AS lh, (tn - n) * p - (tp - pos) AS rg, (tn - n) * p * (1 - p) AS rh, tn * p - tp AS tg, tn * p * (1 - p) AS th FROM hist, t WHERE bin > 0)
SELECT 'l' AS feature, level, round(lg * lg / (lh + 1) + rg * rg / (rh + 1) - tg * tg / (th + 1), 6) AS gain, n_left FROM g WHERE n_left >= 20 AND rn >= 20 AND lg * lg / (lh + 1) + rg * rg / (rh + 1) - tg * tg / (th + 1) > 0""")
def best_split_onehot(spark, sf):
    hist = _with_gradients(splits.histogram(_binned(spark, sf), ["l"], _counts()), "l")
    return splits.onehot_splits(hist, splits.SplitParams()).select("feature", "level", _r("gain"), "n_left")


@query("best_split_catset", """WITH RECURSIVE b AS (SELECT (l_partkey % 40) + 1 AS bin, count(*)::DOUBLE AS n, sum((l_returnflag = 'R')::INT)::DOUBLE AS pos FROM lineitem GROUP BY 1),
t AS (SELECT sum(n) AS tn, sum(pos) / sum(n) AS p FROM b),
lv AS (SELECT bin, n, n * p - pos AS g, n * p * (1 - p) AS h FROM b, t),
whole AS (SELECT sum(n) AS n, sum(g) AS g, sum(h) AS h FROM lv),
used AS (SELECT *, row_number() OVER (ORDER BY g / (h + 10), bin) AS up, count(*) OVER () AS k FROM lv WHERE n >= 10),
ways AS (SELECT 0 AS way, up AS i, bin, n, g, h, k FROM used UNION ALL SELECT 1, k + 1 - up, bin, n, g, h, k FROM used),
c AS (SELECT way, i, sum(n) OVER w AS ln, sum(g) OVER w AS lg, sum(h) OVER w AS lh, list(bin) OVER w AS bins FROM ways WHERE k > 1 AND i <= least(32, (k + 1) // 2) WINDOW w AS (PARTITION BY way ORDER BY i)),
e AS (SELECT c.*, lg * lg / (lh + 11) + (g - lg) * (g - lg) / (h - lh + 11) - g * g / (h + 1) AS gain FROM c, whole WHERE ln >= 20 AND lh >= 1 AND n - ln >= 100 AND h - lh >= 1),
taken AS (
  SELECT * FROM (VALUES (0, 0, 0::DOUBLE), (1, 0, 0::DOUBLE)) v(way, i, base)
  UNION ALL
  SELECT way, i, ln FROM (SELECT e.way, e.i, e.ln, row_number() OVER (PARTITION BY e.way ORDER BY e.i) AS rn FROM taken JOIN e ON e.way = taken.way AND e.i > taken.i AND e.ln - taken.base >= 100) WHERE rn = 1)
SELECT 'c' AS feature, array_to_string(list_sort(bins), ',') AS levels, round(gain, 6) AS gain FROM e JOIN taken USING (way, i) WHERE gain > 0 ORDER BY round(gain, 9) DESC, way, i LIMIT 1""")
def best_split_catset(spark, sf):
    li = table(spark, sf, "lineitem").select(((F.col("l_partkey") % 40) + 1).cast("int").alias("c"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    hist = [(r.bin, r.n, r.g, r.h) for r in _with_gradients(splits.histogram(li, ["c"], _counts()), "c").orderBy("bin").collect()]
    total = tuple(sum(r[i] for r in hist) for i in (1, 2, 3))
    found = splits.category_set(hist, total, splits.SplitParams())
    return spark.createDataFrame([("c", ",".join(map(str, found[1])), round(found[0], 6))] if found else [], "feature string, levels string, gain double")


@query("partition_level", f"""WITH b AS ({_BINNED}) SELECT CASE WHEN node = 1 THEN CASE WHEN q = 0 OR q <= 25 THEN 3 ELSE 4 END WHEN node = 2 THEN CASE WHEN l = 0 THEN 6 WHEN l <= 3 THEN 5 ELSE 6 END END::BIGINT AS node, count(*) AS n, sum(y)::BIGINT AS pos FROM b GROUP BY 1""")
def partition_level(spark, sf):
    s = spark.createDataFrame([(1, "q", 25, True), (2, "l", 3, False)], "node long, feature string, threshold int, missing_left boolean")
    return splits.route(_binned(spark, sf), s, _FEATURES).groupBy("node").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


@query("leaf_newton", f"""WITH b AS ({_BINNED}), p AS (SELECT avg(y) AS p FROM b)
SELECT node::BIGINT AS node, round(-0.1::DOUBLE * (count(*) * p - sum(y)) / (count(*) * p * (1 - p) + 1), 9) AS value FROM b, p GROUP BY node, p""")
def leaf_newton(spark, sf):
    b = _binned(spark, sf)
    p = b.agg(F.avg("y").alias("p"))
    s = b.groupBy("node").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).join(F.broadcast(p))
    sp = splits.SplitParams()
    value = sp.learning_rate * splits.leaf_weight(F.col("n") * F.col("p") - F.col("pos"), F.col("n") * F.col("p") * (1 - F.col("p")), sp)
    return s.select("node", F.round(value, 9).alias("value"))


@query("leaf_percentile", "SELECT l_linenumber AS node, round(quantile_cont(l_quantity - 20, 0.8), 6) AS value FROM lineitem GROUP BY 1")
def leaf_percentile(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("node"), (F.col("l_quantity") - 20).alias("r"))
    return splits.leaf_percentiles(d, "node", "r", 0.8).select("node", _r("value"))


# Metrics

_SCORED = """SELECT ((l_quantity * 7 + l_linenumber * 13 + l_partkey) % 101) / 101.0::DOUBLE AS s, (l_returnflag = 'R')::INT::DOUBLE AS y, l_quantity AS w, l_linenumber::DOUBLE AS k, l_discount * 40 + 1 AS m FROM lineitem"""


def _scored(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select((((F.col("l_quantity") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey")) % 101) / F.lit(101.0)).alias("s"), (F.col("l_returnflag") == "R").cast("double").alias("y"), F.col("l_quantity").alias("w"), F.col("l_linenumber").cast("double").alias("k"), (F.col("l_discount") * 40 + 1).alias("m"))


def _measured(name: str, sql: str, run) -> None:
    @query(name, f"WITH t AS ({_SCORED}) {sql}")
    def q(spark, sf):
        return run(_scored(spark, sf)).select(_r("value"))


def _auc_sql(w: str) -> str:
    return f""", g AS (SELECT s, sum(CASE WHEN y > 0.5 THEN {w} ELSE 0 END) AS p, sum(CASE WHEN y > 0.5 THEN 0 ELSE {w} END) AS q FROM t GROUP BY s),
c AS (SELECT p, q, sum(q) OVER (ORDER BY s) - q AS b FROM g) SELECT round(sum(p * (b + q / 2.0)) / (sum(p) * sum(q)), 6) AS value FROM c"""


_measured("auc", _auc_sql("1"), lambda d: metrics.auc(d, "s", "y"))
_measured("auc_weighted", _auc_sql("w"), lambda d: metrics.auc(d, "s", "y", "w"))
_measured("aucpr", """, g AS (SELECT s, sum(y) AS p, sum(1 - y) AS q FROM t GROUP BY s), c AS (SELECT p, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM g WINDOW w AS (ORDER BY s DESC))
SELECT round(sum(p * tp / (tp + fp)) / sum(p), 6) AS value FROM c""", lambda d: metrics.aucpr(d, "s", "y"))
_measured("logloss", "SELECT round(sum(-w * (y * ln(greatest(least(s, 1 - 1e-7), 1e-7)) + (1 - y) * ln(1 - greatest(least(s, 1 - 1e-7), 1e-7)))) / sum(w), 6) AS value FROM t", lambda d: metrics.logloss(d, "s", "y", "w"))
_measured("logloss_raw", "SELECT round(avg(greatest(s, 0) + ln(1 + exp(-abs(s))) - y * s), 6) AS value FROM t", lambda d: metrics.logloss(d, "s", "y", raw=True))
_measured("error_rate", "SELECT round(avg(((s > 0.5) <> (y > 0.5))::INT), 6) AS value FROM t", lambda d: metrics.error_rate(d, "s", "y"))
_measured("accuracy", "SELECT round(sum(w * ((s > 0.5) = (y > 0.5))::INT) / sum(w), 6) AS value FROM t", lambda d: metrics.accuracy(d, "s", "y", "w"))
_measured("mlogloss", "SELECT round(avg(ln(exp(s) + exp(w / 50) + exp(0.5::DOUBLE)) - CASE k % 3 WHEN 0 THEN s WHEN 1 THEN w / 50 ELSE 0.5 END), 6) AS value FROM t", lambda d: metrics.mlogloss(d.withColumn("a", F.array(F.col("s"), F.col("w") / 50, F.lit(0.5))).withColumn("c", (F.col("k") % 3).cast("int")), "a", "c"))
_measured("accuracy_multiclass", "SELECT round(avg((CASE WHEN s >= w / 50 AND s >= 0.5 THEN 0 WHEN w / 50 >= 0.5 THEN 1 ELSE 2 END = k % 3)::INT), 6) AS value FROM t", lambda d: metrics.accuracy(d.withColumn("a", F.array(F.col("s"), F.col("w") / 50, F.lit(0.5))).withColumn("c", (F.col("k") % 3).cast("int")), "a", "c"))
_measured("rmse", "SELECT round(sqrt(sum(w * (s * 7 - k) * (s * 7 - k)) / sum(w)), 6) AS value FROM t", lambda d: metrics.rmse(d.withColumn("s", F.col("s") * 7), "s", "k", "w"))
_measured("mae", "SELECT round(avg(abs(s * 7 - k)), 6) AS value FROM t", lambda d: metrics.mae(d.withColumn("s", F.col("s") * 7), "s", "k"))
_measured("r2", "SELECT round(1 - sum((s * 7 - k) * (s * 7 - k)) / (SELECT sum((k - a) * (k - a)) FROM t, (SELECT avg(k) AS a FROM t)), 6) AS value FROM t", lambda d: metrics.r2(d.withColumn("s", F.col("s") * 7), "s", "k"))
_measured("pinball", "SELECT round(avg(CASE WHEN k >= s * 7 THEN 0.8::DOUBLE * (k - s * 7) ELSE -0.2::DOUBLE * (k - s * 7) END), 6) AS value FROM t", lambda d: metrics.pinball(d.withColumn("s", F.col("s") * 7), "s", "k", alpha=0.8))
_measured("mphe", "SELECT round(avg(4 * (sqrt(1 + pow((s * 7 - k) / 2, 2)) - 1)), 6) AS value FROM t", lambda d: metrics.mphe(d.withColumn("s", F.col("s") * 7), "s", "k", slope=2.0))
_measured("poisson_nloglik", "SELECT round(avg(m - k * ln(m) + lgamma(k + 1)), 6) AS value FROM t", lambda d: metrics.poisson_nloglik(d, "m", "k"))

# Target statistics and symmetric trees

_LEVELS = "SELECT o_orderkey, o_custkey % 40 AS c, o_orderpriority AS b, (o_orderstatus = 'F')::INT AS y FROM orders"


def _levels(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("c"), F.col("o_orderpriority").alias("b"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


def _ctr_sql(part: str, name: str) -> str:
    return f"""WITH t AS ({_LEVELS}), c AS (SELECT o_orderkey, coalesce(sum(y) OVER w, 0) AS p, count(*) OVER w AS n FROM t WINDOW w AS (PARTITION BY {part} ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o_orderkey, least(floor(((p::FLOAT + 0.5::FLOAT)::FLOAT / (n::FLOAT + 1::FLOAT)::FLOAT)::FLOAT * 15::FLOAT), 15)::INT AS {name} FROM c"""


@query("ctr_borders", _ctr_sql("c", "bucket"))
def ctr_borders(spark, sf):
    d = _levels(spark, sf)
    return d.select("o_orderkey", targets.ctr_borders(d, "c", "y", ["o_orderkey"], 0.5).alias("bucket"))


@query("ctr_combo", _ctr_sql("c, b", "bucket"))
def ctr_combo(spark, sf):
    d = _levels(spark, sf)
    return d.select("o_orderkey", targets.ctr_borders(d, ["c", "b"], "y", ["o_orderkey"], 0.5).alias("bucket"))


@query("ctr_final", f"WITH t AS ({_LEVELS}) SELECT c, least(floor(((sum(y)::FLOAT + 1::FLOAT)::FLOAT / (count(*)::FLOAT + 1::FLOAT)::FLOAT)::FLOAT * 15::FLOAT), 15)::INT AS bucket FROM t GROUP BY c")
def ctr_final(spark, sf):
    return targets.ctr_final(_levels(spark, sf), "c", "y", 1.0)


@query("ctr_counter", f"WITH t AS ({_LEVELS}), n AS (SELECT c, count(*) AS n FROM t GROUP BY c) SELECT c, least(floor((n::FLOAT / ((SELECT max(n) FROM n)::FLOAT + 1::FLOAT)::FLOAT)::FLOAT * 15::FLOAT), 15)::INT AS bucket FROM n")
def ctr_counter(spark, sf):
    return targets.ctr_counter(_levels(spark, sf), "c")


@query("ordered_prefix_score", f"""WITH t AS ({_LEVELS}), r AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, (c > 20)::INT AS side, y FROM t),
n AS (SELECT count(*) AS n, CASE WHEN count(*) <= 500 THEN 1 ELSE least(100, count(*) // 50) END AS b FROM t),
p AS (SELECT i::INT AS prefix, b * (1::BIGINT << i) AS body, least(2 * b * (1::BIGINT << i), n) AS tail FROM n, range(40) x(i) WHERE b * (1::BIGINT << i) < n)
SELECT prefix, side, coalesce(sum(0.5::DOUBLE - y) FILTER (pos < body), 0) AS body_g, count(*) FILTER (pos < body) AS body_n, coalesce(sum(0.5::DOUBLE - y) FILTER (pos >= body), 0) AS tail_g FROM r JOIN p ON pos < tail GROUP BY 1, 2""")
def ordered_prefix_score(spark, sf):
    d = order.positions(_levels(spark, sf), [F.expr("o_orderkey div 4096")], ["o_orderkey"])
    return targets.prefix_sums(d, "pos", "c", 20, 0.5 - F.col("y"), targets.ordered_prefixes(d.count()))


def _symmetric(kind: str, a: str, b: str, value: str) -> None:
    sql = f"""WITH b AS ({_BINNED}), x AS ({_LONG}), hist AS (SELECT feature, bin, count(*) AS n, sum(y)::BIGINT AS pos FROM x GROUP BY 1, 2), r AS (SELECT (sum(pos) / sum(n))::DOUBLE AS p FROM hist WHERE feature = 'd'),
c AS (SELECT feature, bin, sum(n) OVER w AS ln, sum(n) OVER w * p - sum(pos) OVER w AS lg, sum(n) OVER f AS tn, sum(n) OVER f * p - sum(pos) OVER f AS tg, p * (1 - p) AS v FROM hist, r WINDOW w AS (PARTITION BY feature ORDER BY bin), f AS (PARTITION BY feature)),
s AS (SELECT feature, bin AS threshold, ln, lg, tn - ln AS rn, tg - lg AS rg, ln * v AS lh, (tn - ln) * v AS rh FROM c WHERE ln > 0 AND ln < tn)
SELECT feature, threshold, round({value.format(a=a, b=b)}, 6) AS score FROM s"""

    @query(f"symmetric_root_{kind}", sql)
    def run(spark, sf):
        hist = _with_gradients(splits.histogram(_binned(spark, sf), _FEATURES, _counts()), "d")
        return targets.symmetric_scores(hist, kind).select("feature", "threshold", _r("score"))


_A, _B = "(lg * lg / (ln + 1) + rg * rg / (rn + 1))", "(pow(lg / (ln + 1), 2) * ln + pow(rg / (rn + 1), 2) * rn)"
_symmetric("cosine", _A, _B, "{a} / sqrt({b} + 1e-100)")
_symmetric("l2", _A, _B, "{a}")
_symmetric("gain", "lg * lg / (lh + 1) + rg * rg / (rh + 1)", "", "{a}")

# Linear models, blends and explanations in closed form


@query("design_moments", """WITH t AS (SELECT unnest(['quantity', 'discount', 'tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem) SELECT feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM t GROUP BY 1""")
def design_moments(spark, sf):
    from .plans import linear

    li = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return linear.moments(li, ["quantity", "discount", "tax"]).select("feature", _r("mean"), _r("sd"))


@query("ridge_normal_equations", """WITH t AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, l_extendedprice / 10000 AS y FROM lineitem)
SELECT i, j, round(v, 2) AS v FROM (SELECT unnest([0, 0, 0, 1, 1, 2, 0, 1, 2]) AS i, unnest([0, 1, 2, 1, 2, 2, 3, 3, 3]) AS j, unnest([count(*)::DOUBLE, sum(a), sum(b), sum(a * a), sum(a * b), sum(b * b), sum(y), sum(a * y), sum(b * y)]) AS v FROM t)""")
def ridge_normal_equations(spark, sf):
    from .plans import linear

    li = table(spark, sf, "lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_extendedprice") / 10000).alias("y"))
    return linear.normal_equations(li, ["a", "b"], "y").select("i", "j", _r("v", 2))


@query("blend_weighted", "SELECT event_id, round((2.0::DOUBLE * value + 1.0::DOUBLE * user_id) / 3.0::DOUBLE, 6) AS prediction FROM events")
def blend_weighted(spark, sf):
    from .plans import model

    return table(spark, sf, "events").select("event_id", F.round(model.blend([F.col("value"), F.col("user_id")], [2.0, 1.0]), 6).alias("prediction"))


@query("importance", "SELECT l_linenumber AS feature, round(sum(l_quantity), 4) AS gain, round(sum(l_tax), 4) AS cover, count(*) AS splits FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1")
def importance(spark, sf):
    from .plans import explain

    nodes = table(spark, sf, "lineitem").select((F.col("l_linenumber") == 7).alias("is_leaf"), F.col("l_linenumber").alias("feature"), F.col("l_quantity").alias("gain"), F.col("l_tax").alias("cover"))
    return explain.importance(nodes).select("feature", _r("gain", 4), _r("cover", 4), "splits")


@query("stump_predict", "SELECT event_id, round(1 / (1 + exp(-(0.25 + CASE WHEN value <= 100 THEN -1.5 ELSE 2.5 END))), 6) AS prediction FROM events")
def stump_predict(spark, sf):
    from .plans import model

    stump = model.stump("value", 100.0, -1.5, 2.5, 10.0, 30.0, base=0.25)
    return model.predict(table(spark, sf, "events").select("event_id", "value"), stump, keep=["event_id"]).select("event_id", _r("prediction"))


@query("stump_shap", "SELECT event_id, round((CASE WHEN value <= 100 THEN -1.5 ELSE 2.5 END - 1.5)::DOUBLE, 6) AS shap_value, round(0.25 + 1.5, 6)::DOUBLE AS shap_bias FROM events")
def stump_shap(spark, sf):
    from .plans import explain, model

    stump = model.stump("value", 100.0, -1.5, 2.5, 10.0, 30.0, base=0.25)
    return explain.tree_shap(table(spark, sf, "events").select("event_id", "value"), stump, keep=["event_id"]).select("event_id", _r("shap_value"), _r("shap_bias"))


@query("design_onehot", """WITH t AS (SELECT l_quantity AS q, l_returnflag AS f, l_linestatus AS s FROM lineitem)
SELECT 'q' AS name, round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS sd FROM t
UNION ALL SELECT 'f=' || f, round(n / t, 6), round(sqrt(n / t * (1 - n / t)), 6) FROM (SELECT f, count(*)::DOUBLE AS n, (SELECT count(*) FROM t)::DOUBLE AS t FROM t GROUP BY f)
UNION ALL SELECT 's=' || s, round(n / t, 6), round(sqrt(n / t * (1 - n / t)), 6) FROM (SELECT s, count(*)::DOUBLE AS n, (SELECT count(*) FROM t)::DOUBLE AS t FROM t GROUP BY s)""")
def design_onehot(spark, sf):
    from .plans import linear

    li = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"))
    d = linear.design(li, {"q": "numeric", "f": "categorical", "s": "categorical"})
    names = [f"__d{i}" for i in range(len(d.names))]
    shown = F.element_at(F.create_map(*(F.lit(x) for pair in zip(names, d.names) for x in pair)), F.col("feature"))
    return linear.moments(d.applied(li), names).select(shown.alias("name"), _r("mean"), _r("sd"))


@query("linear_shap", """WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_tax) AS c, stddev_pop(l_tax) AS d FROM lineitem)
SELECT l_linenumber, round(avg(abs(0.7::DOUBLE * (l_quantity - a) / b)), 6) AS quantity, round(avg(abs(-0.2::DOUBLE * (l_tax - c) / d)), 6) AS tax FROM lineitem, m GROUP BY 1""")
def linear_shap(spark, sf):
    from .plans import explain, linear

    li = table(spark, sf, "lineitem").select("l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    stats = {r["feature"]: (r["mean"], r["sd"]) for r in linear.moments(li, ["quantity", "tax"]).collect()}
    shap = explain.linear_shap(li, {"quantity": 0.7, "tax": -0.2}, stats)
    return shap.groupBy("l_linenumber").agg(F.round(F.avg(F.abs("shap_quantity")), 6).alias("quantity"), F.round(F.avg(F.abs("shap_tax")), 6).alias("tax"))


# Fitted models: the driver checks rows only; tests hold them against brute force.

_KINDS = {"quantity": "numeric", "discount": "numeric", "tax": "numeric", "line": "numeric", "ship": "numeric", "brand": "categorical"}


def training_rows(spark, sf) -> DataFrame:
    """A table to learn from: lineitem with a stable row id, a missing feature, a category and three labels."""
    li = table(spark, sf, "lineitem")
    d = li.select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("row_id"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.when(F.col("l_linenumber") != 7, F.col("l_linenumber").cast("double")).alias("line"), F.month("l_shipdate").cast("double").alias("ship"), F.concat(F.lit("b"), (F.col("l_partkey") % 25).cast("string")).alias("brand"), (F.col("l_returnflag") == "R").cast("double").alias("returned"), (F.col("l_extendedprice") / 10000).alias("price"))
    noise = F.pmod(F.col("row_id"), F.lit(1000)) / 1000.0
    late = (F.col("quantity") > 25).cast("double") * 0.45 + (F.coalesce(F.col("line"), F.lit(0.0)) < 3).cast("double") * 0.25 + noise * 0.6
    return d.withColumn("late", (late > 0.65).cast("double"))


def _fitted(name: str, params) -> None:
    @query(name)
    def run(spark, sf):
        from .plans import boost, model

        d = training_rows(spark, sf)
        m = boost.train(d, _KINDS, "late", params)
        return model.predict(d, m, ["row_id", "late"])


def _register_fitted() -> None:
    from dataclasses import replace

    from .plans import boost

    base = boost.BoostParams(n_rounds=5, tree=boost.TreeParams(max_depth=4))
    _fitted("gbdt_depthwise", base)
    _fitted("gbdt_lossguide", replace(base, tree=boost.TreeParams("lossguide", 0, 8)))
    _fitted("gbdt_symmetric", replace(base, tree=boost.TreeParams("symmetric", 4)))
    _fitted("gbdt_goss", replace(base, sampling="goss", goss_warmup=False))
    _fitted("gbdt_optimal_categories", replace(base, tree=boost.TreeParams(max_depth=4, cat_split="optimal")))


_register_fitted()


@query("forest")
def forest(spark, sf):
    from .plans import boost, model

    d = training_rows(spark, sf)
    m = boost.train_forest(d, _KINDS, "late", boost.ForestParams(n_trees=8, max_depth=5))
    return model.predict(d, m, ["row_id", "late"])


_STUMP = """WITH r AS (SELECT l_quantity::DOUBLE AS q, l_discount::DOUBLE AS d, l_tax::DOUBLE AS t, (l_returnflag = 'R')::INT AS y FROM lineitem),
x AS (SELECT unnest([0, 1, 2]) AS i, unnest([q, d, t]) AS v, y FROM r),
p AS (SELECT avg(y) AS p, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM r),
k AS (SELECT i, v, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM x GROUP BY 1, 2),
c AS (SELECT i, v, lead(v) OVER w AS nxt, sum(n) OVER w AS ln, sum(pos) OVER w AS lp FROM k WINDOW w AS (PARTITION BY i ORDER BY v)),
g AS (SELECT i, ((v::FLOAT + nxt::FLOAT) * 0.5::FLOAT)::FLOAT::DOUBLE AS edge, ln, ln * p.p - lp AS lg, ln * p.p * (1 - p.p) AS lh, (p.n - ln) * p.p - (p.pos - lp) AS rg, (p.n - ln) * p.p * (1 - p.p) AS rh FROM c, p WHERE nxt IS NOT NULL),
best AS (SELECT *, lg * lg / (lh + 1) + rg * rg / (rh + 1) AS gain FROM g WHERE ln >= 20 AND (SELECT n FROM p) - ln >= 20 AND lh >= 1 AND rh >= 1 ORDER BY round(gain, 9) DESC, i, edge LIMIT 1)
SELECT policy, ['q', 'd', 't'][i + 1] AS feature, round(edge, 6) AS edge, ln::BIGINT AS n_left, round(-0.1 * lg / (lh + 1), 6) AS left_value, round(-0.1 * rg / (rh + 1), 6) AS right_value FROM best, (VALUES ('depthwise'), ('lossguide')) v(policy)"""


@query("gbdt_stump", _STUMP)
def gbdt_stump(spark, sf):
    """One round of one split by either policy."""
    from .plans import boost

    li = table(spark, sf, "lineitem").select(F.monotonically_increasing_id().alias("row_id"), F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"), F.col("l_tax").cast("double").alias("t"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    out = []
    for policy in ("depthwise", "lossguide"):
        m = boost.train(li, {"q": "numeric", "d": "numeric", "t": "numeric"}, "y", boost.BoostParams(1, tree=boost.TreeParams(policy, 1, 2)))
        t, f = m.trees[0], m.schema.features[m.trees[0].feature[0]]
        out.append((policy, f.name, round(f.edges[t.threshold[0] - 1], 6), int(t.count[t.left[0]]), round(t.value[t.left[0]], 6), round(t.value[t.right[0]], 6)))
    return spark.createDataFrame(out, "policy string, feature string, edge double, n_left long, left_value double, right_value double")


@query("logistic_gradient", "SELECT unnest(['quantity', 'discount', 'tax', 'intercept']) AS feature, 0.0::DOUBLE AS gradient")
def logistic_gradient(spark, sf):
    """The objective's gradient at a fitted logistic model: 0 to four decimals."""
    from .plans import linear

    d = training_rows(spark, sf)
    names = ["quantity", "discount", "tax"]
    m = linear.fit(d, names, "late", linear.LinearParams(reg_lambda=5.0, tol=1e-10))
    xs = linear.scaled(names, m.stats)
    off = losses.sigmoid(linear.raw_scores(m)[0]) - F.col("late")
    got = d.agg(*(F.avg(off * x).alias(n) for n, x in zip(names, xs)), F.avg(off).alias("intercept"), F.count("*").alias("n")).first()
    grads = [(n, got[n] + 5.0 * w / got["n"]) for n, w in zip(names, m.coefficients[0])] + [("intercept", got["intercept"])]
    return spark.createDataFrame([(n, round(g, 4) + 0.0) for n, g in grads], "feature string, gradient double")


@query("linear_fit")
def linear_fit(spark, sf):
    from .plans import linear

    d = training_rows(spark, sf)
    m = linear.fit(d, ["quantity", "discount", "tax", "line"], "late")
    return linear.predict(d, m).select("row_id", "late", "prediction")


@query("cv_oof")
def cv_oof(spark, sf):
    from .plans import linear, search

    d = rows.folds(training_rows(spark, sf), ["row_id"], 3, 1, "late").persist()
    r = search.cross_validate(d, "late", lambda t: linear.fit(t, ["quantity", "line"], "late"), linear.predict, "auc", k=3)
    return r.oof.select("row_id", "fold", F.col("late").alias("label"), F.round("prediction", 8).alias("prediction"))


@query("tune_random")
def tune_random(spark, sf):
    from .plans import linear, search

    d = rows.folds(training_rows(spark, sf), ["row_id"], 2, 1, "late").persist()
    axes = [search.Axis.parse("reg_lambda=0.01..100:log"), search.Axis.parse("standardize=0,1")]

    def evaluate(p: dict, k: int) -> float:
        how = linear.LinearParams(reg_lambda=p["reg_lambda"], standardize=p["standardize"] == "1")
        return search.cross_validate(d, "late", lambda t: linear.fit(t, ["quantity", "line"], "late", how), linear.predict, "auc", k=2, first=min(k, 2)).mean

    return search.trial_table(spark, search.search(axes, evaluate, "random", 3, 2)).drop("ms")


@query("tree_shap")
def tree_shap(spark, sf):
    from .plans import boost, explain

    d = training_rows(spark, sf)
    m = boost.train(d, _KINDS, "late", boost.BoostParams(n_rounds=3, tree=boost.TreeParams(max_depth=4)))
    return explain.tree_shap(d, m, ["row_id"])


@query("model_importance")
def model_importance(spark, sf):
    from .plans import boost, explain

    m = boost.train(training_rows(spark, sf), _KINDS, "late", boost.BoostParams(n_rounds=3, tree=boost.TreeParams(max_depth=4)))
    return explain.importance(m.nodes(spark))
