"""Jobs that label stints and build the modelling panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellkit.functions import text as tx
from dwellkit.functions.numeric import duration_class, ratio_with_ties, rounded
from dwellkit.operators import labels as lb
from dwellkit.operators import pit
from dwellkit.operators import stints as st
from dwellkit.plans.base import history, rnd, seasons, sql, stints, table
from dwellkit.plans.registry import job
from dwellkit.session import materialized

# A season's primary flag: unknown for single-record seasons, else more wins than losses.
PRIMARY = "CASE WHEN n_rows > 1 THEN w > l END"


def season_rows(spark, sf):
    """The season table, written once: stints, flags and features all read it."""
    return materialized(seasons(spark, sf))


ANCHOR = f"""SELECT s.entity, s.stint_no, s.start_season, s.end_season, s.duration,
  CASE WHEN any_p IS NULL THEN 'clean' WHEN NOT any_p THEN 'interim_only' WHEN first_p = s.start_season THEN 'clean' ELSE 'reanchor' END AS anchor_kind,
  CASE WHEN any_p AND first_p > s.start_season THEN first_p ELSE s.start_season END AS anchor
  FROM (SELECT s.entity, s.stint_no, s.start_season, s.end_season, s.duration, bool_or(p) AS any_p, min(q.season) FILTER (p) AS first_p
    FROM stints s JOIN (SELECT entity, season, {PRIMARY} AS p FROM seasons) q
      ON q.entity = s.entity AND q.season BETWEEN s.start_season AND s.end_season GROUP BY ALL) s"""


def _anchored(per):
    s = st.stint_islands(per.select("entity", "season"), "entity", "season").drop("n_seasons")
    flags = per.select("entity", "season", F.when(F.col("n_rows") > 1, F.col("w") > F.col("l")).alias("primary"))
    return lb.classify_anchor(s, flags, ["entity"], "season", "primary")


@job("classify_anchor", sql("SELECT * FROM anchored", "stints", anchored=ANCHOR))
def classify_anchor(spark, sf):
    return _anchored(season_rows(spark, sf))


@job("clean_population", sql("""SELECT entity, start_season, anchor, anchor_kind FROM anchored WHERE anchor_kind <> 'interim_only'
  AND (entity, start_season) NOT IN (SELECT entity, max(start_season) FROM stints WHERE duration = 1 GROUP BY entity)""", "stints", anchored=ANCHOR))
def clean_population(spark, sf):
    listed = (stints(spark, sf).filter("duration = 1").groupBy("entity")
              .agg(F.max("start_season").alias("start_season")))
    return lb.clean_population(_anchored(season_rows(spark, sf)), listed, ["entity", "start_season"]).select(
        "entity", "start_season", "anchor", "anchor_kind")


@job("exit_type", sql("""
SELECT entity, start_season, end_season, age, exit_kind, CASE WHEN exit_kind IN ('active', 'retired') THEN 0 ELSE 1 END AS event FROM (
  SELECT s.entity, s.start_season, s.end_season, 45 + c_nationkey AS age, CASE WHEN s.end_season >= (SELECT b FROM boundary) THEN 'active'
    WHEN lead(s.start_season) OVER (PARTITION BY s.entity ORDER BY s.start_season) IS NOT NULL THEN 'fired_or_moved'
    WHEN 45 + c_nationkey >= 62 THEN 'retired' ELSE 'fired_out' END AS exit_kind
  FROM stints s LEFT JOIN customer ON c_custkey = s.entity)""", "stints", "boundary"))
def exit_type(spark, sf):
    s = st.close_previous(stints(spark, sf), "entity")
    age = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), (45 + F.col("c_nationkey")).alias("age"))
    boundary = history(spark, sf).agg(F.max("season")).scalar()
    out = s.join(age, "entity", "left").withColumn("exit_kind", lb.exit_type(
        F.col("end_season"), boundary, F.col("next_start").isNotNull(), F.col("age")))
    return out.select("entity", "start_season", "end_season", "age", "exit_kind", lb.exit_event(F.col("exit_kind")).alias("event"))


# A stint at one unit: it ends with a gap or when the unit changes, so an entity may be elsewhere the very next season.
KEYED = """SELECT entity, min(season) AS start_season, max(season) AS end_season, stint_key FROM (
  SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY season) AS no FROM (
    SELECT entity, season, last_priority AS stint_key, CASE WHEN season - lag(season) OVER w <= 1
      AND last_priority = lag(last_priority) OVER w THEN 0 ELSE 1 END AS new
    FROM seasons WINDOW w AS (PARTITION BY entity ORDER BY season))) GROUP BY entity, no, stint_key"""
SIGNALS = """SELECT k.entity, k.start_season, k.end_season, k.stint_key, count(a.entity) > 0 AS active_after,
  coalesce(bool_or(a.h AND a.priority <> k.stint_key), false) AS head_elsewhere_after,
  coalesce(bool_or(a.h AND a.priority <> k.stint_key AND a.season = k.end_season + 1), false) AS head_elsewhere_next
  FROM keyed k LEFT JOIN (SELECT entity, season, priority, bool_or(status = 'F') AS h FROM history GROUP BY 1, 2, 3) a
    ON a.entity = k.entity AND a.season > k.end_season GROUP BY 1, 2, 3, 4"""


def _keyed(per):
    """Stints of consecutive seasons at one unit, with that unit."""
    per = per.select("entity", "season", F.col("last_priority").alias("priority"))
    marked = st.number_islands(per, "entity", "season", st.same_value("entity", "season", "priority"))
    return marked.groupBy("entity", "stint_no").agg(
        F.min("season").alias("start_season"), F.max("season").alias("end_season"),
        F.min_by("priority", "season").alias("stint_key"))


def _signals(spark, sf, stint_rows):
    activity = history(spark, sf).groupBy("entity", "season", "priority").agg(
        F.bool_or(F.col("status") == "F").alias("head"))
    return lb.post_exit_signals(stint_rows, activity, "entity", "season", "priority", "head", "stint_key")


@job("post_exit_signals", sql("SELECT entity, start_season, end_season, stint_key, active_after, head_elsewhere_after, head_elsewhere_next FROM signals",
                              "stints", keyed=KEYED, signals=SIGNALS))
def post_exit_signals(spark, sf):
    return _signals(spark, sf, _keyed(seasons(spark, sf)))


# The season note an entity gets from the priority of its last record.
NOTES = {"1-URGENT": "Was Fired midseason", "2-HIGH": "Resigned; mutual decision", "3-MEDIUM": "Retired for health reasons"}


@job("event_label_rules", sql("""
SELECT entity, start_season, label, kind, confidence, needs_check FROM (SELECT entity, start_season,
  CASE WHEN k IN ('fired_notes', 'resigned_notes', 'losing_finale') THEN 'event' ELSE 'censor' END AS label, k AS kind,
  CASE WHEN k IN ('active', 'fired_notes', 'losing_finale') THEN 'high' ELSE 'low' END AS confidence,
  k NOT IN ('active', 'fired_notes', 'losing_finale') AS needs_check
  FROM (SELECT s.entity, s.start_season, CASE WHEN s.end_season >= (SELECT b FROM boundary) THEN 'active'
      WHEN q.last_priority = '1-URGENT' THEN 'fired_notes' WHEN q.last_priority = '2-HIGH' THEN 'resigned_notes'
      WHEN (q.w + 0.5 * q.t) / (q.w + q.l + q.t) < 0.5 THEN 'losing_finale' WHEN s.head_elsewhere_next THEN 'moved_team?'
      WHEN q.last_priority = '3-MEDIUM' THEN 'voluntary_note?' ELSE 'nonlosing_left?' END AS k
    FROM signals s JOIN seasons q ON q.entity = s.entity AND q.season = s.end_season))""",
    "stints", "boundary", keyed=KEYED, signals=SIGNALS))
def event_label_rules(spark, sf):
    note = F.coalesce(*[F.when(F.col("last_priority") == p, F.lit(n)) for p, n in NOTES.items()])
    per = season_rows(spark, sf)
    last = per.select("entity", F.col("season").alias("end_season"), note.alias("note"),
                                     ratio_with_ties(F.col("w"), F.col("l"), F.col("t")).alias("ratio"))
    s = _signals(spark, sf, _keyed(per)).join(last, ["entity", "end_season"])
    boundary = per.agg(F.max("season")).scalar()
    lab = lb.event_label(F.col("end_season"), boundary, tx.keyword_flag(F.col("note"), tx.FORCED_WORDS),
                         tx.keyword_flag(F.col("note"), tx.RESIGNED_WORDS),
                         tx.keyword_flag(F.col("note"), tx.VOLUNTARY_WORDS), F.col("ratio"), F.col("head_elsewhere_next"))
    return s.select("entity", "start_season", lab.alias("_l")).select("entity", "start_season", "_l.*")


@job("competing_targets", sql("""
SELECT s.entity, s.end_season, s.duration, CASE WHEN ev = 1 THEN 1 WHEN s.end_season >= (SELECT b FROM boundary) THEN 0 ELSE 2 END AS cause,
  CASE WHEN ev = 1 THEN 1 ELSE 0 END AS event
FROM (SELECT s.*, coalesce(CASE q.last_priority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 0 END,
    CASE WHEN s.end_season >= (SELECT b FROM boundary) THEN 0 ELSE 1 END) AS ev
  FROM stints s JOIN seasons q ON q.entity = s.entity AND q.season = s.end_season) s""", "stints", "boundary"))
def competing_targets(spark, sf):
    known = F.when(F.col("last_priority") == "1-URGENT", 1).when(F.col("last_priority") == "5-LOW", 0)
    labels = seasons(spark, sf).select("entity", F.col("season").alias("end_season"), known.alias("ev")).filter("ev IS NOT NULL")
    boundary = history(spark, sf).agg(F.max("season")).scalar()
    out = lb.competing_targets(stints(spark, sf), labels, ["entity", "end_season"], "ev", boundary)
    return out.select("entity", "end_season", "duration", "cause", "event")


@job("tenure_class_final", sql("""
SELECT entity, start_season, end_season, CASE WHEN start_season > 2000 THEN NULL WHEN start_season >= 1998 AND NOT (last_status = 'P' OR end_season < 1999) THEN -1
  WHEN duration <= 2 THEN 0 WHEN duration <= 4 THEN 1 ELSE 2 END AS final_class FROM stints
WHERE (entity, start_season) IN (SELECT entity, max(start_season) FROM stints GROUP BY entity)""", "stints"))
def tenure_class_final(spark, sf):
    marked = st.number_islands(seasons(spark, sf), "entity", "season")
    s = marked.groupBy("entity", "stint_no").agg(
        F.min("season").alias("start_season"), F.max("season").alias("end_season"),
        F.max_by("last_is_p", "season").alias("last_is_p"))
    last = s.groupBy("entity").agg(F.max("start_season").alias("start_season"), F.max("end_season").alias("end_season"),
                                   F.max_by("last_is_p", "stint_no").alias("last_is_p"))
    return last.select("entity", "start_season", "end_season", lb.final_class(
        F.col("start_season"), F.col("end_season"), 2000, 1998, F.col("last_is_p") == 1).alias("final_class"))


PANEL = """SELECT a.entity, a.anchor, CAST(coalesce(sum(q.n_rows), 0) AS BIGINT) AS prior_orders, count(q.season) AS prior_seasons,
  coalesce(sum(q.spend), 0) AS prior_spend, max(q.season) AS last_seen, arg_max(q.last_priority, q.season) AS last_key
  FROM pop a LEFT JOIN seasons q ON q.entity = a.entity AND q.season < a.anchor GROUP BY 1, 2"""
POP = """SELECT entity, anchor, CAST(end_season - anchor + 1 AS INTEGER) AS duration, end_season FROM anchored
  WHERE anchor_kind <> 'interim_only' AND start_season >= 1996"""


@job("build_panel", sql(f"""
SELECT p.entity, p.anchor, k.prior_orders, k.prior_seasons, {rnd('k.prior_spend', 2)} AS prior_spend,
  CAST(p.anchor - k.last_seen - 1 AS INTEGER) AS gap, k.last_key, {rnd('avg(c.spend)', 4)} AS lookback_spend,
  {rnd('(SELECT avg((w + 0.5 * t) / (w + l + t)) FROM seasons f WHERE f.entity = p.entity AND f.season IN (p.anchor, p.anchor + 1))')} AS forward_ratio,
  CASE WHEN p.duration <= 2 THEN 0 WHEN p.duration <= 4 THEN 1 ELSE 2 END AS label
FROM pop p JOIN panel k USING (entity, anchor) LEFT JOIN seasons c ON c.entity = p.entity AND c.season IN (p.anchor - 1, p.anchor - 2)
GROUP BY ALL""", "stints", anchored=ANCHOR, pop=POP, panel=PANEL))
def build_panel(spark, sf):
    """Anchors, era filter, hygiene, relabelling, features, targets, from a season table that is written first."""
    per = season_rows(spark, sf)
    pop = (_anchored(per).filter("start_season >= 1996").filter("anchor_kind <> 'interim_only'")
           .withColumn("duration", (F.col("end_season") - F.col("anchor") + 1).cast("int"))
           .select("entity", "anchor", "duration"))
    x = pit.pit_features(pop, per, ["entity"], "anchor", "season",
                         {"prior_orders": F.col("n_rows"), "prior_seasons": F.lit(1), "prior_spend": F.col("spend")},
                         latest=["season", "last_priority"])
    x = pit.lookback_mean(x, per, ["entity"], "anchor", "season", {"lookback_spend": F.col("spend")})
    ratio = ratio_with_ties(F.col("w"), F.col("l"), F.col("t"))
    x = pit.lookback_mean(x, per, ["entity"], "anchor", "season", {"forward_ratio": ratio}, offsets=(0, -1))
    return x.select("entity", "anchor", "prior_orders", "prior_seasons", rounded(F.col("prior_spend"), 2).alias("prior_spend"),
                    (F.col("anchor") - F.col("last_season") - 1).cast("int").alias("gap"),
                    F.col("last_last_priority").alias("last_key"), rounded(F.col("lookback_spend"), 4).alias("lookback_spend"),
                    rounded(F.col("forward_ratio")).alias("forward_ratio"), duration_class(F.col("duration")).alias("label"))
