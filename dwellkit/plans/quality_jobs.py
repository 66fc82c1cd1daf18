"""Jobs on set operations, version differences and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellkit.functions.hashing import hash_int
from dwellkit.functions.numeric import rounded
from dwellkit.operators import quality as ql
from dwellkit.operators import stints as st
from dwellkit.plans.base import features, history, rnd, seasons, sql, stints, table, targets
from dwellkit.plans.registry import job
from dwellkit.session import materialized
from dwellkit.plans.window_jobs import RUNS

# A second version of orders: some prices raised, statuses blanked, rows dropped, keys moved.
NEW_SQL = """SELECT CASE WHEN o_orderkey % 107 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey,
  CASE WHEN o_orderkey % 109 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 89 = 0 THEN o_totalprice + 0.001 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 83 = 0 THEN '0-NEW' ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 103 <> 0"""


def new_orders(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    price = F.col("o_totalprice")
    return o.filter(k % 103 != 0).select(
        F.when(k % 107 == 0, -k - 1).otherwise(k).alias("o_orderkey"),
        F.when(k % 109 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(k % 101 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 97 == 0, price + 1).when(k % 89 == 0, price + 0.001).otherwise(price).alias("o_totalprice"),
        F.when(k % 83 == 0, "0-NEW").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


@job("key_set_diff", sql("""
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CAST(coalesce(na, 0) AS BIGINT) AS n_old, CAST(coalesce(nb, 0) AS BIGINT) AS n_new,
  CASE WHEN na IS NULL THEN 'added' WHEN nb IS NULL THEN 'removed' WHEN na <> nb THEN 'changed' ELSE 'same' END AS status
FROM (SELECT o_custkey, count(*) AS na FROM orders GROUP BY 1) a
FULL JOIN (SELECT o_custkey, count(*) AS nb FROM newer GROUP BY 1) b ON a.o_custkey = b.o_custkey""", newer=NEW_SQL))
def key_set_diff(spark, sf):
    return ql.key_set_diff(table(spark, sf, "orders"), new_orders(spark, sf), ["o_custkey"])


CELLS = """SELECT o_orderkey, 'o_orderstatus' AS "column", CASE WHEN (a.o_orderstatus IS NULL) <> (b.o_orderstatus IS NULL) THEN 'null_change'
    WHEN a.o_orderstatus <> b.o_orderstatus THEN 'other' END AS kind FROM orders a JOIN newer b USING (o_orderkey)
  UNION ALL SELECT o_orderkey, 'o_totalprice', CASE WHEN abs(a.o_totalprice - b.o_totalprice) > 0.01 THEN 'numeric' END FROM orders a JOIN newer b USING (o_orderkey)
  UNION ALL SELECT o_orderkey, 'o_orderpriority', CASE WHEN a.o_orderpriority <> b.o_orderpriority THEN 'other' END FROM orders a JOIN newer b USING (o_orderkey)"""
DIFF_COLS = ["o_orderstatus", "o_totalprice", "o_orderpriority"]


def _cells(spark, sf):
    return ql.cell_diff(table(spark, sf, "orders"), new_orders(spark, sf), ["o_orderkey"], DIFF_COLS)


@job("cell_diff", sql('SELECT o_orderkey, "column", kind FROM cells WHERE kind IS NOT NULL', newer=NEW_SQL, cells=CELLS))
def cell_diff(spark, sf):
    return _cells(spark, sf).select("o_orderkey", "column", "kind")


@job("diff_summary", sql('SELECT "column", kind, count(*) AS n_diffs FROM cells WHERE kind IS NOT NULL GROUP BY 1, 2',
                         newer=NEW_SQL, cells=CELLS))
def diff_summary(spark, sf):
    return ql.diff_summary(_cells(spark, sf), ["column", "kind"])


TEST = "('0x' || substr(md5(concat_ws(':', '42', CAST(entity AS VARCHAR))), 1, 8))::BIGINT % 5 = 0"


def in_test(entity="entity"):
    return hash_int(42, F.col(entity)) % 5 == 0


@job("union_augment", sql(f"""
SELECT entity, start_season, 'train' AS origin FROM targets WHERE NOT ({TEST}) AND cause <> 0
UNION ALL SELECT entity, start_season, 'open' FROM targets WHERE cause = 0 AND entity NOT IN (SELECT entity FROM targets WHERE {TEST} AND cause <> 0)""",
    "targets"))
def union_augment(spark, sf):
    t = materialized(targets(spark, sf))
    known, test = t.filter("cause <> 0"), in_test()
    train = known.filter(~test).select("entity", "start_season", F.lit("train").alias("origin"))
    held_out = known.filter(test).select("entity").distinct()
    extra = (t.filter("cause = 0").join(held_out, "entity", "left_anti")
             .select("entity", "start_season", F.lit("open").alias("origin")))
    return train.unionByName(extra)


@job("attach_columns", sql(f"""
SELECT s.entity, s.start_season, q.n_rows, {rnd('q.spend', 2)} AS spend, s.duration, s.label
FROM targets s LEFT JOIN seasons q ON q.entity = s.entity AND q.season = s.start_season""", "targets"))
def attach_columns(spark, sf):
    base = targets(spark, sf).select("entity", "start_season", "duration", "label")
    new = seasons(spark, sf).select("entity", F.col("season").alias("start_season"), "n_rows",
                                    rounded(F.col("spend"), 2).alias("spend"))
    # Joined by key; the targets stay last.
    return base.join(new, ["entity", "start_season"], "left").select(
        "entity", "start_season", "n_rows", "spend", "duration", "label")


@job("dq_duplicates", "SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def dq_duplicates(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("season"))
    return ql.duplicates(o, ["o_custkey", "season"])


RANGES = {"prior_orders": (0, 5), "mean_price": (1.0, 3.0), "gap": (0, 2), "acctbal": (0, 9)}


@job("dq_ranges", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS n_missing, count(*) FILTER (isinf({c}) OR isnan({c})) AS n_not_finite, "
    f"count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS n_out_of_range FROM features" for c, (lo, hi) in RANGES.items()), "features"))
def dq_ranges(spark, sf):
    return ql.range_checks(features(spark, sf), RANGES)


@job("dq_group_leak", sql("""
SELECT entity, min(side) AS first_side, max(side) AS last_side, count(*) AS n FROM (
  SELECT entity, CASE WHEN ('0x' || substr(md5(concat_ws(':', '42', CAST(entity AS VARCHAR), CAST(start_season AS VARCHAR))), 1, 8))::BIGINT % 5 = 0
    THEN 'test' ELSE 'train' END AS side FROM targets) GROUP BY 1 HAVING min(side) <> max(side)""", "targets"))
def dq_group_leak(spark, sf):
    # A split by row instead of by entity leaks; the check must find every such entity.
    side = F.when(hash_int(42, F.col("entity"), F.col("start_season")) % 5 == 0, "test").otherwise("train")
    return ql.group_leaks(targets(spark, sf).withColumn("side", side), ["entity"], "side")


@job("dq_mapping_cover", """
WITH m AS (SELECT o_orderpriority AS alias, lower(o_orderpriority) AS key FROM orders WHERE o_orderpriority < '4' GROUP BY 1
  UNION ALL SELECT lower(o_orderpriority), 'low' FROM orders WHERE o_orderpriority < '2' GROUP BY 1)
SELECT DISTINCT o_orderpriority AS code, 'uncovered' AS issue FROM orders WHERE o_orderpriority NOT IN (SELECT alias FROM m)
UNION ALL SELECT DISTINCT alias, 'alias_and_key' FROM m WHERE alias IN (SELECT key FROM m)""")
def dq_mapping_cover(spark, sf):
    codes = materialized(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("code")).distinct())
    mapping = (codes.filter("code < '4'").select(F.col("code").alias("alias"), F.lower("code").alias("key"))
               .unionByName(codes.filter("code < '2'").select(F.lower("code").alias("alias"), F.lit("low").alias("key"))))
    return ql.mapping_cover(codes, mapping, "code")


@job("dq_overlapping_stints", sql("""
SELECT entity, priority, run_start, run_end, next_start FROM (
  SELECT *, lead(run_start) OVER (PARTITION BY entity ORDER BY run_start, priority) AS next_start FROM runs) WHERE next_start <= run_end""",
    "history", runs=RUNS))
def dq_overlapping_stints(spark, sf):
    runs = st.run_islands(history(spark, sf), ["entity", "priority"], "season")
    return ql.overlapping_spans(runs, "entity", "run_start", "run_end", ["priority"]).select(
        "entity", "priority", "run_start", "run_end", "next_start")


@job("dq_label_consistency", sql("""
SELECT entity, start_season, duration, tenure, stored, label FROM (
  SELECT t.entity, t.start_season, t.duration, CAST(r.run_end - t.start_season + 1 AS INTEGER) AS tenure,
    CASE WHEN t.duration = 3 AND t.cause = 2 THEN 0 ELSE t.label END AS stored, t.label
  FROM targets t JOIN (SELECT entity, min(season) AS run_start, max(season) AS run_end FROM marked GROUP BY entity, grp) r
    ON r.entity = t.entity AND t.start_season BETWEEN r.run_start AND r.run_end) WHERE stored <> label OR duration <> tenure""", "targets"))
def dq_label_consistency(spark, sf):
    stored = F.when((F.col("duration") == 3) & (F.col("cause") == 2), 0).otherwise(F.col("label"))
    t = targets(spark, sf).withColumn("stored", stored)
    hist = st.seasons_of(history(spark, sf), "entity", "season")
    both = st.tenure_run_forward(t, hist, ["entity"], "start_season", "season")
    return (both.filter((F.col("stored") != F.col("label")) | (F.col("duration") != F.col("tenure")))
            .select("entity", "start_season", "duration", "tenure", "stored", "label"))


@job("dq_path_agreement", sql("""
SELECT CASE WHEN stored = member THEN 'agree' ELSE 'differ' END AS verdict, member, count(*) AS n FROM (
  SELECT d.entity, d.priority, d.season, CAST(p.entity IS NOT NULL AS INTEGER) AS member,
    CASE WHEN d.season = 1999 THEN 1 ELSE CAST(p.entity IS NOT NULL AS INTEGER) END AS stored
  FROM (SELECT DISTINCT entity, priority, season FROM history) d LEFT JOIN (SELECT DISTINCT entity, priority, season + 1 AS season FROM history) p
    ON p.entity = d.entity AND p.priority = d.priority AND p.season = d.season) GROUP BY 1, 2""", "history"))
def dq_path_agreement(spark, sf):
    from pyspark.sql import Window as W

    from dwellkit.operators.pit import member_before

    keys = ["entity", "priority"]
    rows = st.seasons_of(history(spark, sf), "entity", "season", "priority")
    hist = rows.select(*keys, F.col("season").alias("y"))
    by_join = member_before(rows, hist, keys, "season", "y", "by_join")
    by_run = st.run_backward(by_join, hist, keys, "season", "y", "run")
    prev = F.lag("season").over(W.partitionBy(*keys).orderBy("season"))
    both = (by_run.withColumn("by_lag", F.coalesce((prev == F.col("season") - 1).cast("int"), F.lit(0)))
            .withColumn("by_run", (F.col("run") > 0).cast("int"))
            .withColumn("stored", F.when(F.col("season") == 1999, 1).otherwise(F.col("by_join"))))
    verdict = ql.agreement(F.col("stored"), F.col("by_join"), F.col("by_lag"), F.col("by_run"))
    return (both.groupBy(verdict.alias("verdict"), F.col("by_join").alias("member"))
            .agg(F.count(F.lit(1)).alias("n")))


TRUTH = [(1, 1), (2, 2), (3, 1), (5, 2), (8, 1), (13, 3), (21, 2), (34, 1), (-1, 1)]


@job("dq_curated_truth", sql(f"""
SELECT entity, expected, n_stints AS actual, CASE WHEN n_stints IS NULL THEN 'n.a.' WHEN n_stints = expected THEN 'OK' ELSE 'WRONG' END AS verdict
FROM (VALUES {", ".join(f"({a}::BIGINT, {b}::BIGINT)" for a, b in TRUTH)}) v(entity, expected)
LEFT JOIN (SELECT entity, count(*) AS n_stints FROM stints GROUP BY 1) USING (entity)""", "stints"))
def dq_curated_truth(spark, sf):
    expected = spark.createDataFrame(TRUTH, "entity bigint, n_stints bigint")
    actual = stints(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("n_stints"))
    return ql.curated_truth(actual, expected, ["entity"], "n_stints")


PUBLISHED = [("mean_duration", 2.99, 2), ("share_open", 0.34, 2), ("share_event", 0.4, 1)]


@job("dq_tolerance_check", sql(f"""
SELECT name, published, decimals, {rnd('actual')} AS actual, abs(actual - published) <= 0.5 * pow(10, -decimals) + 1e-12 AS ok
FROM (VALUES {", ".join(f"('{n}', {v}::DOUBLE, {d})" for n, v, d in PUBLISHED)}) p(name, published, decimals)
LEFT JOIN (SELECT 'mean_duration' AS name, avg(duration) AS actual FROM targets UNION ALL SELECT 'share_open', avg(CAST(cause = 0 AS INTEGER)) FROM targets
  UNION ALL SELECT 'share_event', avg(event) FROM targets) USING (name)""", "targets"))
def dq_tolerance_check(spark, sf):
    one = targets(spark, sf).agg(F.avg("duration").alias("mean_duration"),
                                 F.avg((F.col("cause") == 0).cast("int")).alias("share_open"), F.avg("event").alias("share_event"))
    actual = one.unpivot([], ["mean_duration", "share_open", "share_event"], "name", "actual")
    published = spark.createDataFrame(PUBLISHED, "name string, published double, decimals int")
    out = ql.tolerance_check(actual, published)
    return out.withColumn("actual", rounded(F.col("actual")))
