"""Jobs on windows, sequences and stint logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellkit.functions.numeric import rounded
from dwellkit.operators import stints as st
from dwellkit.operators import survival as sv
from dwellkit.plans.base import history, rnd, seasons, sql, stints, table, targets
from dwellkit.plans.registry import job


@job("stint_islands", sql(
    "SELECT entity, stint_no, start_season, end_season, n_seasons, duration FROM stints", "stints"))
def stint_islands(spark, sf):
    return stints(spark, sf)


@job("stint_islands_either_key", sql("""
SELECT entity, CAST(stint_no AS INTEGER) AS stint_no, min(season) AS start_season, max(season) AS end_season,
  count(*) AS n_seasons, arg_min(last_status, season) AS last_status,
  arg_min(last_priority, season) AS last_priority, CAST(max(season) - min(season) + 1 AS INTEGER) AS duration
FROM (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY season) AS stint_no FROM (
  SELECT *, CASE WHEN season - lag(season) OVER w <= 1 AND (last_status = lag(last_status) OVER w
    OR last_priority = lag(last_priority) OVER w) THEN 0 ELSE 1 END AS new
  FROM seasons WINDOW w AS (PARTITION BY entity ORDER BY season)))
GROUP BY entity, stint_no""", "seasons"))
def stint_islands_either_key(spark, sf):
    return st.stint_islands(seasons(spark, sf), "entity", "season",
                            ["last_status", "last_priority"], either=True)


RUNS = """SELECT entity, priority, min(season) AS run_start, max(season) AS run_end FROM (
  SELECT *, season - row_number() OVER (PARTITION BY entity, priority ORDER BY season) AS g
  FROM (SELECT DISTINCT entity, priority, season FROM history)) GROUP BY entity, priority, g"""
# The unit of a stint's last season, looked up at its start: some entities were not there yet.
ANCHORS = """SELECT s.entity, s.start_season, q.last_priority AS priority FROM stints s
  JOIN seasons q ON q.entity = s.entity AND q.season = s.end_season"""


def anchors(spark, sf):
    """Stint starts with the unit (priority) of the stint's last season."""
    per = seasons(spark, sf).select("entity", "season", "last_priority")
    return (st.number_islands(per, "entity", "season").groupBy("entity", "stint_no")
            .agg(F.min("season").alias("start_season"), F.max_by("last_priority", "season").alias("priority"))
            .drop("stint_no"))


@job("tenure_run_forward", sql("""
SELECT a.entity, a.start_season, a.priority, CAST(r.run_end - a.start_season + 1 AS INTEGER) AS tenure
FROM anchors a LEFT JOIN runs r ON a.entity = r.entity AND a.priority = r.priority
  AND a.start_season BETWEEN r.run_start AND r.run_end""", "stints", runs=RUNS, anchors=ANCHORS))
def tenure_run_forward(spark, sf):
    return st.tenure_run_forward(anchors(spark, sf), history(spark, sf), ["entity", "priority"],
                                 "start_season", "season")


@job("run_backward", sql("""
SELECT a.entity, a.season, a.priority, CAST(coalesce(a.season - r.run_start, 0) AS INTEGER) AS run_length
FROM (SELECT entity, season, last_priority AS priority FROM seasons) a
LEFT JOIN runs r ON a.entity = r.entity AND a.priority = r.priority
  AND a.season - 1 BETWEEN r.run_start AND r.run_end""", "seasons", runs=RUNS))
def run_backward(spark, sf):
    per = seasons(spark, sf).select("entity", "season", F.col("last_priority").alias("priority"))
    hist = history(spark, sf).select("entity", "priority", F.col("season").alias("h_season"))
    return st.run_backward(per, hist, ["entity", "priority"], "season", "h_season")


@job("cumulative_snapshot", sql(f"""
SELECT entity, season, CAST(coalesce(sum(n_rows) OVER w, 0) AS BIGINT) AS prior_orders,
  CAST(coalesce(sum(w) OVER w, 0) AS BIGINT) AS prior_wins,
  {rnd('sum(spend) OVER w / sum(n_rows) OVER w', 6)} AS prior_mean_price
FROM seasons WINDOW w AS (PARTITION BY entity ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "seasons"))
def cumulative_snapshot(spark, sf):
    out = st.cumulative_snapshot(
        seasons(spark, sf), "entity", "season",
        {"prior_orders": F.col("n_rows"), "prior_wins": F.col("w")},
        {"prior_mean_price": (F.col("spend"), F.col("n_rows"))})
    return out.withColumn("prior_mean_price", rounded(F.col("prior_mean_price"), 6))


@job("prior_stint_count", sql("""SELECT entity, start_season,
  CAST(count(*) OVER (PARTITION BY entity ORDER BY start_season) - 1 AS INTEGER) AS prior_stints FROM stints""", "stints"))
def prior_stint_count(spark, sf):
    return (st.prior_stint_count(stints(spark, sf), "entity")
            .select("entity", "start_season", "prior_stints"))


@job("gap_before", sql("""SELECT entity, season,
  CAST(season - lag(season) OVER (PARTITION BY entity ORDER BY season) - 1 AS INTEGER) AS gap
  FROM (SELECT DISTINCT entity, season FROM history)""", "history"))
def gap_before(spark, sf):
    return st.gap_before(st.seasons_of(history(spark, sf), "entity", "season"), "entity", "season")


@job("dedupe_keep_first", sql("""
SELECT entity, season, status, priority, record FROM history WHERE priority = '5-LOW'
UNION ALL
SELECT entity, season, status, priority, min(record) AS record FROM history WHERE priority <> '5-LOW'
GROUP BY entity, season, status, priority""", "history"))
def dedupe_keep_first(spark, sf):
    hist = history(spark, sf).select("entity", "season", "status", "priority", "record")
    return st.dedupe_keep_first(hist, ["entity", "season", "status", "priority"], ["record"],
                                keep_all=F.col("priority") == "5-LOW")


@job("close_previous", sql("""
SELECT entity, start_season, lead(start_season) OVER w AS next_start,
  CAST(least(end_season + 1, coalesce(lead(start_season) OVER w, end_season + 1)) - start_season AS INTEGER) AS closed_length
FROM (SELECT entity, run_start AS start_season, max(run_end) AS end_season FROM runs GROUP BY 1, 2)
WINDOW w AS (PARTITION BY entity ORDER BY start_season)""", "history", runs=RUNS))
def close_previous(spark, sf):
    """Runs at a unit, which overlap: a run is closed by the next one or by the gap after it."""
    runs = st.run_islands(history(spark, sf), ["entity", "priority"], "season")
    spells = runs.groupBy("entity", F.col("run_start").alias("start_season")).agg(F.max("run_end").alias("end_season"))
    return (st.close_previous(spells, "entity")
            .select("entity", "start_season", "next_start", "closed_length"))


@job("season_number_cumsum", sql(f"""
SELECT entity, season, season_no, {rnd('cum', 2)} AS cum_measure FROM (
  SELECT entity, season, CAST(row_number() OVER w AS INTEGER) AS season_no, sum(spend) OVER w AS cum
  FROM seasons WINDOW w AS (PARTITION BY entity ORDER BY season)) WHERE season_no <= 5""", "seasons"))
def season_number_cumsum(spark, sf):
    out = st.season_number_cumsum(seasons(spark, sf), "entity", "season", "spend", first_n=5)
    return out.select("entity", "season", "season_no", rounded(F.col("cum_measure"), 2).alias("cum_measure"))


@job("trajectory_by_group", sql(f"""
SELECT c_mktsegment AS segment, season_no, count(*) AS n, {rnd('avg(cum)', 2)} AS mean_cum,
  {rnd('stddev_samp(cum)', 2)} AS sd_cum
FROM (SELECT entity, CAST(row_number() OVER w AS INTEGER) AS season_no, sum(spend) OVER w AS cum
  FROM seasons WINDOW w AS (PARTITION BY entity ORDER BY season))
JOIN customer ON c_custkey = entity GROUP BY 1, 2""", "seasons"))
def trajectory_by_group(spark, sf):
    cum = st.season_number_cumsum(seasons(spark, sf), "entity", "season", "spend")
    cust = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return (cum.join(cust, F.col("entity") == F.col("c_custkey")).groupBy("segment", "season_no")
            .agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("cum_measure"), 2).alias("mean_cum"),
                 rounded(F.stddev_samp("cum_measure"), 2).alias("sd_cum")))


@job("top_n_per_group", sql(f"""
SELECT segment, entity, {rnd('best', 2)} AS best, rank_no FROM (
  SELECT c_mktsegment AS segment, entity, best,
    CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY best DESC, entity) AS INTEGER) AS rank_no
  FROM (SELECT entity, max(spend) AS best FROM seasons GROUP BY entity) JOIN customer ON c_custkey = entity)
WHERE rank_no <= 3""", "seasons"))
def top_n_per_group(spark, sf):
    best = seasons(spark, sf).groupBy("entity").agg(F.max("spend").alias("best"))
    cust = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    top = st.top_n_per_group(best.join(cust, F.col("entity") == F.col("c_custkey")), ["segment"],
                             [F.desc("best"), F.asc("entity")], 3)
    return top.select("segment", "entity", rounded(F.col("best"), 2).alias("best"), "rank_no")


@job("mode_per_group", sql("""
SELECT entity, label AS modal, n AS modal_count, CAST(n_rows AS BIGINT) AS n_rows FROM (
  SELECT entity, label, n, sum(n) OVER (PARTITION BY entity) AS n_rows,
    row_number() OVER (PARTITION BY entity ORDER BY n DESC, label) AS rn
  FROM (SELECT entity, label, count(*) AS n FROM targets GROUP BY entity, label)) WHERE rn = 1""", "targets"))
def mode_per_group(spark, sf):
    return st.mode_per_group(targets(spark, sf), ["entity"], "label")


@job("age_carry", sql("""
SELECT q.entity, q.season, CAST(coalesce(nullif(q.n_rows, 2) + 20, f.first_age + q.season - f.first_season) AS BIGINT) AS age_at
FROM seasons q LEFT JOIN (SELECT entity, min(season) AS first_season, arg_min(n_rows + 20, season) AS first_age
  FROM seasons WHERE n_rows <> 2 GROUP BY entity) f ON q.entity = f.entity""", "seasons"))
def age_carry(spark, sf):
    # The "age" of a season is missing where it has exactly two records.
    per = seasons(spark, sf).withColumn("age", F.when(F.col("n_rows") != 2, F.col("n_rows") + 20))
    known = per.filter("age IS NOT NULL").groupBy("entity").agg(
        F.min("season").alias("first_season"), F.min_by("age", "season").alias("first_age"))
    return (st.age_carry(per.join(known, "entity", "left"), F.col("age"), F.col("first_age"),
                         F.col("season") - F.col("first_season"))
            .select("entity", "season", "age_at"))


@job("conditional_step", sql(f"""
SELECT duration, {rnd('s')} AS s, {rnd('s / coalesce(lag(s) OVER (ORDER BY duration), 1)')} AS step_survival
FROM km""", "targets",
    risk="""SELECT duration, sum(count(*)) OVER (ORDER BY duration DESC) AS n, count(*) FILTER (event = 1) AS d
        FROM targets GROUP BY duration""",
    km="SELECT duration, product(1 - d / n) OVER (ORDER BY duration) AS s FROM risk"))
def conditional_step(spark, sf):
    curve = sv.km_curve(targets(spark, sf), "duration", "event").select("duration", "s")
    return sv.conditional_step(curve, "duration").select(
        "duration", rounded(F.col("s")).alias("s"), rounded(F.col("step_survival")).alias("step_survival"))


@job("step_read", sql(f"""
SELECT p.pt, {rnd("coalesce(arg_max(s, duration), 1.0)")} AS s
FROM (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS pt) p LEFT JOIN km ON km.duration <= p.pt GROUP BY p.pt""",
    "targets",
    risk="""SELECT duration, sum(count(*)) OVER (ORDER BY duration DESC) AS n, count(*) FILTER (event = 1) AS d
        FROM targets GROUP BY duration""",
    km="SELECT duration, product(1 - d / n) OVER (ORDER BY duration) AS s FROM risk"))
def step_read(spark, sf):
    curve = sv.km_curve(targets(spark, sf), "duration", "event").select("duration", "s")
    points = spark.range(10).select(F.col("id").cast("int").alias("pt"))
    out = st.step_read(points, "pt", curve, "duration", "s", empty=1.0)
    return out.select("pt", rounded(F.col("s")).alias("s"))
