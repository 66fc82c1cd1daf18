"""How a stint began and ended: anchors, exit types, event labels, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellkit.functions.numeric import duration_class
from dwellkit.operators.pit import interval_contains


def classify_anchor(stints: DataFrame, flags: DataFrame, keys: list[str], season: str, primary: str,
                    start: str = "start_season", end: str = "end_season") -> DataFrame:
    """clean / interim_only / reanchor from the primary flags over a stint's seasons.

    No known flag leaves the stint clean; never primary is interim; primary only later moves
    the anchor to the first primary season.
    """
    inside = interval_contains(flags.filter(F.col(primary).isNotNull()).select(*keys, season, primary),
                               stints.select(*keys, start, end), keys, season, start, end)
    p = F.col(primary)
    seen = inside.filter("matched").groupBy(*keys, start).agg(
        F.bool_or(p).alias("_any"), F.min(F.when(p, F.col(season))).alias("_first"))
    kind = (F.when(F.col("_any").isNull(), "clean").when(~F.col("_any"), "interim_only")
            .when(F.col("_first") == F.col(start), "clean").otherwise("reanchor"))
    return (stints.join(seen, [*keys, start], "left")
            .withColumn("anchor_kind", kind)
            .withColumn("anchor", F.when(F.col("anchor_kind") == "reanchor", F.col("_first")).otherwise(F.col(start)))
            .drop("_any", "_first"))


def clean_population(classified: DataFrame, listed: DataFrame, on: list[str]) -> DataFrame:
    """Drop listed duplicates and interim-only stints; the rest keep their (moved) anchor."""
    return (classified.join(listed, on, "left_anti").filter(F.col("anchor_kind") != "interim_only"))


def exit_type(last: Column, boundary: Column, active_after: Column, age: Column, retire_age: int = 62) -> Column:
    """active, fired_or_moved, retired or fired_out."""
    return (F.when(last >= boundary, "active").when(active_after, "fired_or_moved")
            .when(F.coalesce(age >= retire_age, F.lit(False)), "retired").otherwise("fired_out"))


def exit_event(kind: Column) -> Column:
    """1 for an involuntary exit, 0 for a censored one."""
    return F.when(kind.isin("active", "retired"), 0).otherwise(1)


def post_exit_signals(stints: DataFrame, activity: DataFrame, entity: str, season: str, key: str, head: str,
                      stint_key: str, end: str = "end_season", start: str = "start_season") -> DataFrame:
    """Any activity after the stint, head elsewhere ever after, head elsewhere the next season.

    ``activity`` has one row per (entity, season, key), so what an entity brings into the
    join is bounded by seasons x keys.
    """
    after = activity.select(F.col(entity).alias("_e"), F.col(season).alias("_y"), F.col(key).alias("_k"),
                            F.col(head).alias("_h"))
    elsewhere = F.col("_h") & ~F.col("_k").eqNullSafe(F.col(stint_key))
    joined = stints.join(after, (F.col(entity) == F.col("_e")) & (F.col("_y") > F.col(end)), "left")
    return joined.groupBy(entity, start, end, stint_key).agg(
        (F.count("_e") > 0).alias("active_after"),
        F.coalesce(F.bool_or(elsewhere), F.lit(False)).alias("head_elsewhere_after"),
        F.coalesce(F.bool_or(elsewhere & (F.col("_y") == F.col(end) + 1)), F.lit(False)).alias("head_elsewhere_next"))


def event_label(last: Column, boundary: Column, forced: Column, resigned: Column, voluntary: Column,
                ratio: Column, head_next: Column) -> Column:
    """Ordered decision as struct(label, kind, confidence, needs_check)."""
    def out(label, kind, confidence, check):
        return F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"),
                        F.lit(confidence).alias("confidence"), F.lit(check).alias("needs_check"))
    losing = F.coalesce(ratio < 0.5, F.lit(False))
    return (F.when(last >= boundary, out("censor", "active", "high", False))
            .when(forced, out("event", "fired_notes", "high", False))
            .when(resigned, out("event", "resigned_notes", "low", True))
            .when(losing, out("event", "losing_finale", "high", False))
            .when(head_next, out("censor", "moved_team?", "low", True))
            .when(voluntary, out("censor", "voluntary_note?", "low", True))
            .otherwise(out("censor", "nonlosing_left?", "low", True)))


def competing_targets(stints: DataFrame, labels: DataFrame, on: list[str], label: str, boundary: Column,
                      end: str = "end_season") -> DataFrame:
    """cause 1 event, 2 competing, 0 open; a missing label defaults by the boundary."""
    open_ = F.col(end) >= boundary
    ev = F.coalesce(F.col("_l"), F.when(open_, 0).otherwise(1))
    cause = F.when(ev == 1, 1).when(open_, 0).otherwise(2)
    return (stints.join(labels.select(*on, F.col(label).alias("_l")), on, "left")
            .withColumn("cause", cause).withColumn("event", (F.col("cause") == 1).cast("int")).drop("_l"))


def final_class(start: Column, last_active: Column, current: int, cutoff: int, known_ended: Column,
                low: int = 2, high: int = 4) -> Column:
    """Class of the last stint: NULL for future anchors, -1 while open, else from its length."""
    length = last_active + 1 - start
    ended = known_ended | (last_active < current - 1)
    return (F.when(start > current, F.lit(None).cast("int"))
            .when((start >= cutoff) & ~ended, F.lit(-1))
            .otherwise(duration_class(length, low, high)))
