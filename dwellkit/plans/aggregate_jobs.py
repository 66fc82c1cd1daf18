"""Jobs on grouped summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellkit.functions.numeric import ratio_with_ties, rounded, safe_div
from dwellkit.operators import aggregates as ag
from dwellkit.operators import pit
from dwellkit.plans.base import FEATURES, features, history, rnd, seasons, sql, stints, table, targets
from dwellkit.plans.registry import job
from dwellkit.session import materialized
from dwellkit.plans.units import SIDES_SQL, UNITS_SQL, unit_seasons, unit_sides


def _z(c):
    return (f"CASE WHEN count({c}) OVER w = count(*) OVER w AND stddev_pop({c}) OVER w > 0 "
            f"THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END")


@job("zscore_by_period", sql(f"""
SELECT unit, season, {rnd(_z('price'))} AS price, {rnd(_z('discount'))} AS discount, {rnd(_z('n_lines'))} AS n_lines
FROM (SELECT unit, season, price, discount, CASE WHEN season = 1998 THEN nullif(n_lines, max_lines) ELSE n_lines END AS n_lines
  FROM units, (SELECT max(n_lines) AS max_lines FROM units WHERE season = 1998)) WINDOW w AS (PARTITION BY season)""", units=UNITS_SQL))
def zscore_by_period(spark, sf):
    u = unit_seasons(spark, sf).select("unit", "season", "price", "discount", "n_lines")
    # One season gets a missing value, which makes that measure missing for all of it.
    top = u.filter("season = 1998").agg(F.max("n_lines")).scalar()
    u = u.withColumn("n_lines", F.when((F.col("season") != 1998) | (F.col("n_lines") != top), F.col("n_lines")))
    z = ag.zscore_by_period(u, "season", ["price", "discount", "n_lines"])
    return z.select("unit", "season", *[rounded(F.col(c)).alias(c) for c in ("price", "discount", "n_lines")])


ROLE_OF = "['HC', 'OC', 'DC'][CAST(unit % 3 + 1 AS INTEGER)]"


@job("pooled_two_sided_mean", sql(f"""
SELECT s_nationkey AS nation, {rnd("avg(g * price)", 4)} AS price, {rnd("avg(-g * discount)")} AS discount
FROM (SELECT *, {ROLE_OF} AS role, CASE side WHEN 'own' THEN 1 ELSE -1 END AS g FROM sides) JOIN supplier ON s_suppkey = unit
WHERE role = 'HC' OR (role = 'OC' AND side = 'own') OR (role = 'DC' AND side = 'opp') GROUP BY 1""", sides=SIDES_SQL))
def pooled_two_sided_mean(spark, sf):
    role = F.element_at(F.array(F.lit("HC"), F.lit("OC"), F.lit("DC")), (F.col("unit") % 3 + 1).cast("int"))
    nation = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_nationkey").alias("nation"))
    held = (unit_seasons(spark, sf).select("unit", "season").withColumn("role", role).join(nation, "unit"))
    out = ag.pooled_two_sided_mean(held, unit_sides(spark, sf), "unit", "season", "role", ["nation"],
                                   {"price": 1.0, "discount": -1.0})
    return out.select("nation", rounded(F.col("price"), 4).alias("price"), rounded(F.col("discount")).alias("discount"))


@job("weighted_collapse", sql(f"""
SELECT unit, {rnd('CASE WHEN sum(n_lines) FILTER (v IS NOT NULL) > 0 THEN sum(v * n_lines) / sum(n_lines) FILTER (v IS NOT NULL) END')} AS collapsed
FROM (SELECT unit, side, sum(n_lines) AS n_lines,
  CASE WHEN side = 'own' OR unit % 5 <> 0 THEN (CASE side WHEN 'own' THEN 1 ELSE -1 END) * avg(discount) END AS v FROM sides GROUP BY 1, 2)
GROUP BY 1""", sides=SIDES_SQL))
def weighted_collapse(spark, sf):
    side = F.col("side")
    u = unit_sides(spark, sf).groupBy("unit").agg(
        F.avg(F.when(side == "own", F.col("discount"))).alias("own"),
        F.avg(F.when((side == "opp") & (F.col("unit") % 5 != 0), F.col("discount"))).alias("opp"),
        F.sum(F.when(side == "own", F.col("n_lines")).otherwise(0)).alias("w_own"),
        F.sum(F.when(side == "opp", F.col("n_lines")).otherwise(0)).alias("w_opp"))
    out = ag.weighted_collapse([(F.col("own"), F.col("w_own")), (-F.col("opp"), F.col("w_opp"))])
    return u.select("unit", rounded(out).alias("collapsed"))


@job("conditional_counts", sql("""
SELECT entity, count(*) FILTER (status = 'F' AND priority = '1-URGENT') AS n_f_urgent,
  count(*) FILTER (status = 'F' AND priority <> '1-URGENT') AS n_f_other,
  count(*) FILTER (status = 'O') AS n_open, count(*) FILTER (status = 'P' AND priority LIKE '5%') AS n_p_low
FROM history GROUP BY 1""", "history"))
def conditional_counts(spark, sf):
    s, p = F.col("status"), F.col("priority")
    return history(spark, sf).groupBy("entity").agg(
        F.count_if((s == "F") & (p == "1-URGENT")).alias("n_f_urgent"),
        F.count_if((s == "F") & (p != "1-URGENT")).alias("n_f_other"),
        F.count_if(s == "O").alias("n_open"), F.count_if((s == "P") & p.like("5%")).alias("n_p_low"))


@job("distinct_counts", sql(f"""
SELECT entity, count(DISTINCT CASE WHEN status = 'F' THEN priority END) AS n_f_keys,
  count(DISTINCT CASE WHEN status <> 'F' THEN priority END) AS n_other_keys,
  {rnd("count(*) FILTER (status = 'F') / count(*)")} AS f_share, min(season) FILTER (status = 'F') AS first_f,
  coalesce(bool_or(priority = '1-URGENT' AND status = 'F'), false) AS ever_f_urgent FROM history GROUP BY 1""", "history"))
def distinct_counts(spark, sf):
    f = F.col("status") == "F"
    out = ag.distinct_by_condition(
        history(spark, sf), ["entity"], "priority", {"n_f_keys": f, "n_other_keys": ~f},
        {"n_f": (f.cast("int"), "sum"), "n": (F.lit(1), "sum"), "first_f": (F.when(f, F.col("season")), "min"),
         "urgent": ((f & (F.col("priority") == "1-URGENT")).cast("int"), "max")})
    return out.select("entity", "n_f_keys", "n_other_keys", rounded(F.col("n_f") / F.col("n")).alias("f_share"),
                      "first_f", (F.col("urgent") == 1).alias("ever_f_urgent"))


HEADS = """SELECT c_nationkey AS unit, season, arg_max(entity, (spend, -entity)) AS head
  FROM seasons JOIN customer ON c_custkey = entity GROUP BY 1, 2"""


@job("distinct_in_window", sql("""
SELECT a.unit, a.season, count(DISTINCT h.head) AS n_distinct FROM heads a
LEFT JOIN heads h ON h.unit = a.unit AND h.season BETWEEN a.season - 3 AND a.season - 1 GROUP BY 1, 2""",
    "seasons", heads=HEADS))
def distinct_in_window(spark, sf):
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("unit"))
    heads = seasons(spark, sf).join(cust, "entity").groupBy("unit", "season").agg(
        F.max_by("entity", F.struct("spend", -F.col("entity"))).alias("head"))
    return ag.distinct_in_window(heads, "unit", "season", "head",
                                 heads.select("unit", F.col("season").alias("anchor")), "anchor", 3
                                 ).withColumnRenamed("anchor", "season")


@job("stint_average", sql(f"""
SELECT s.entity, s.stint_no, {rnd('avg(q.spend)', 6)} AS mean_spend, count(*) AS n_seasons, CAST(sum(q.n_rows) AS BIGINT) AS n_rows
FROM stints s JOIN seasons q ON q.entity = s.entity AND q.season BETWEEN s.start_season AND s.end_season GROUP BY 1, 2""", "stints"))
def stint_average(spark, sf):
    rows = pit.interval_contains(seasons(spark, sf).select("entity", "season", "spend", "n_rows"), stints(spark, sf),
                                 ["entity"], "season", carry=["stint_no"])
    return rows.filter("matched").groupBy("entity", "stint_no").agg(
        rounded(F.avg("spend"), 6).alias("mean_spend"), F.count(F.lit(1)).alias("n_seasons"), F.sum("n_rows").alias("n_rows"))


@job("forward_window_mean", sql(f"""
SELECT s.entity, s.start_season, count(r) AS n_forward, {rnd('''CASE WHEN s.start_season >= 2000 AND count(r) < 2 THEN coalesce(avg(r), -1) ELSE avg(r) END''')} AS forward_mean
FROM stints s LEFT JOIN (SELECT entity, season, CASE WHEN w + l > 0 THEN (w + 0.0) / (w + l) END AS r FROM seasons) q
  ON q.entity = s.entity AND q.season IN (s.start_season, s.start_season + 1) GROUP BY 1, 2""", "stints"))
def forward_window_mean(spark, sf):
    ratio = ratio_with_ties(F.col("w"), F.col("l"), F.lit(0))
    out = pit.forward_mean(stints(spark, sf).select("entity", "start_season"), seasons(spark, sf), ["entity"],
                           "start_season", "season", ratio, recent_from=2000)
    return out.select("entity", "start_season", "n_forward", rounded(F.col("forward_mean")).alias("forward_mean"))


@job("group_summary", f"""
SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, {rnd('avg(o_totalprice)', 4)} AS mean,
  {rnd('stddev_samp(o_totalprice)', 4)} AS sd, min(o_totalprice) AS low, max(o_totalprice) AS high,
  {rnd('median(o_totalprice)', 4)} AS median FROM orders GROUP BY 1, 2 HAVING count(*) >= 3""")
def group_summary(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"),
                                          F.col("o_orderstatus").alias("status"), "o_totalprice")
    out = ag.group_summary(o, ["priority", "status"], "o_totalprice", min_n=3)
    return out.select("priority", "status", "n", "low", "high",
                      *[rounded(F.col(c), 4).alias(c) for c in ("mean", "sd", "median")])


@job("pivot_mean", f"""
SELECT o_orderpriority AS priority, {rnd("avg(o_totalprice) FILTER (year(o_orderdate) < 2000)", 4)} AS "1990s",
  {rnd("avg(o_totalprice) FILTER (year(o_orderdate) >= 2000)", 4)} AS "2000s" FROM orders GROUP BY 1""")
def pivot_mean(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("priority"), "o_totalprice",
        F.when(F.year("o_orderdate") < 2000, "1990s").otherwise("2000s").alias("decade"))
    p = o.groupBy("priority").pivot("decade", ["1990s", "2000s"]).agg(F.avg("o_totalprice"))
    return p.select("priority", *[rounded(F.col(c), 4).alias(c) for c in ("1990s", "2000s")])


@job("class_distribution", sql(f"""
SELECT label, n, {rnd('n / sum(n) OVER ()')} AS share, expected, abs(n / sum(n) OVER () - expected) <= 0.05 AS ok
FROM (SELECT label, count(*) AS n, CAST(CASE label WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END AS DOUBLE) AS expected
  FROM targets GROUP BY label)""", "targets"))
def class_distribution(spark, sf):
    out = ag.class_distribution(targets(spark, sf), "label", {0: 0.5, 1: 0.3, 2: 0.2}, 0.05)
    return out.withColumn("share", rounded(F.col("share")))


@job("missingness_profile", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_missing, {rnd(f'(count(*) - count({c})) / count(*)')} AS share_missing, "
    f"{rnd(f'count({c}) / count(*)')} AS coverage FROM features" for c in FEATURES), "features"))
def missingness_profile(spark, sf):
    return ag.missingness_profile(features(spark, sf), FEATURES).select(
        "feature", "n_missing", rounded(F.col("share_missing")).alias("share_missing"), rounded(F.col("coverage")).alias("coverage"))


@job("corr_with_target", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(regr_count(duration, {c}) AS BIGINT) AS n_pairs, "
    f"{rnd(f'CASE WHEN regr_count(duration, {c}) > 10 THEN corr(duration, {c}) END')} AS r FROM features" for c in FEATURES), "features"))
def corr_with_target(spark, sf):
    return ag.corr_with_target(features(spark, sf), FEATURES, "duration").select(
        "feature", "n_pairs", rounded(F.col("r")).alias("r"))


LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@job("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {rnd(f'corr({a}, {b})')} AS r, abs(corr({a}, {b})) > 0.5 AS strong FROM lineitem"
    for i, a in enumerate(LINE_COLS) for b in LINE_COLS[i + 1:]))
def corr_matrix(spark, sf):
    return ag.corr_matrix(table(spark, sf, "lineitem"), LINE_COLS).select(
        "a", "b", rounded(F.col("r")).alias("r"), (F.abs("r") > 0.5).alias("strong"))


VIF = ["prior_orders", "acctbal", "nation"]
# With three columns the inverse correlation matrix has a closed form.
VIF_SQL = " UNION ALL ".join(f"""SELECT '{a}' AS feature, {rnd('(1 - bc * bc) / det')} AS vif FROM (
  SELECT bc, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM (
    SELECT corr({a}, {b}) AS ab, corr({a}, {c}) AS ac, corr({b}, {c}) AS bc FROM features))"""
                             for a, b, c in ((VIF[0], VIF[1], VIF[2]), (VIF[1], VIF[0], VIF[2]), (VIF[2], VIF[0], VIF[1])))


@job("vif", sql(VIF_SQL, "features"))
def vif(spark, sf):
    out = ag.vif(features(spark, sf), VIF)
    return out.select("feature", rounded(F.col("vif")).alias("vif"))


@job("slope_last_k", sql(f"""
SELECT entity, count(x) AS n_points, {rnd('CASE WHEN count(x) >= 2 THEN regr_slope(v, x) END', 4)} AS slope FROM (
  SELECT entity, v, CASE WHEN v IS NOT NULL THEN count(v) OVER (PARTITION BY entity ORDER BY season) - 1 END AS x FROM (
    SELECT entity, season, CASE WHEN n_rows <> 2 THEN spend END AS v,
      row_number() OVER (PARTITION BY entity ORDER BY season DESC) AS back FROM seasons) WHERE back <= 3) GROUP BY entity""", "seasons"))
def slope_last_k(spark, sf):
    per = seasons(spark, sf).select("entity", "season", F.when(F.col("n_rows") != 2, F.col("spend")).alias("v"))
    out = ag.slope_last_k(per, ["entity"], "season", "v", 3)
    return out.withColumn("slope", rounded(F.col("slope"), 4))


@job("boundary_max", sql("SELECT entity, end_season, end_season >= (SELECT b FROM boundary) AS open FROM stints", "stints", "boundary"))
def boundary_max(spark, sf):
    b = history(spark, sf).agg(F.max("season")).scalar()
    return stints(spark, sf).select("entity", "end_season", (F.col("end_season") >= b).alias("open"))


CATEGORY = {"prior_orders": "history", "prior_spend": "history", "mean_price": "history", "gap": "timing",
            "acctbal": "profile", "nation": "profile"}
IMPORTANCE = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{CATEGORY[c]}' AS category, abs(corr(duration, {c})) AS value FROM features" for c in FEATURES)


@job("category_rollup", sql(f"""
SELECT category, {rnd('sum(value)')} AS total, {rnd('avg(value)')} AS mean, count(*) AS n_features,
  {rnd("(SELECT avg(value) FILTER (category = 'history') / avg(value) FILTER (category = 'profile') FROM importance)", 4)} AS ratio
FROM importance GROUP BY category""", "features", importance=IMPORTANCE))
def category_rollup(spark, sf):
    imp = ag.corr_with_target(features(spark, sf), FEATURES, "duration").select("feature", F.abs("r").alias("value"))
    roll = materialized(ag.category_rollup(imp, CATEGORY))
    ratio = ag.two_group_ratio(roll, "history", "profile").scalar()
    return roll.select("category", rounded(F.col("total")).alias("total"), rounded(F.col("mean")).alias("mean"),
                       "n_features", rounded(ratio, 4).alias("ratio"))


@job("cube_report", sql(f"""
SELECT label, cause, era, CAST(grouping(label) * 4 + grouping(cause) * 2 + grouping(era) AS BIGINT) AS level, count(*) AS n,
  {rnd('avg(duration)')} AS mean_duration
FROM (SELECT *, CASE WHEN start_season < 1998 THEN 'early' ELSE 'late' END AS era FROM targets) GROUP BY CUBE (label, cause, era)""", "targets"))
def cube_report(spark, sf):
    t = targets(spark, sf).withColumn("era", F.when(F.col("start_season") < 1998, "early").otherwise("late"))
    return t.cube("label", "cause", "era").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), rounded(F.avg("duration")).alias("mean_duration"))
