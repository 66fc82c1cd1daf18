"""Spells from entity-season panels: islands, runs, snapshots, de-duplication.

Inputs at record level are first aggregated to one row per (entity, season), which combines
on the map side; a window then sees at most one row per season of an entity, however many
records a hot entity has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seasons_of(df: DataFrame, entity: str, season: str, *more: str) -> DataFrame:
    """Distinct (entity, season, ...)."""
    return df.select(entity, season, *more).distinct()


def number_islands(df: DataFrame, entity: str, season: str, same: Column | None = None,
                   max_gap: int = 1) -> DataFrame:
    """Add ``stint_no``: a new one at the first row, after a gap, or when ``same`` fails.

    ``same`` is a Boolean built from ``lag`` over ``entity_order``; NULL counts as a change.
    """
    order = entity_order(entity, season)
    prev = F.lag(season).over(order)
    new = prev.isNull() | (F.col(season) - prev > max_gap)
    if same is not None:
        new = new | ~F.coalesce(same, F.lit(False))
    return (df.withColumn("_new", new.cast("int"))
            .withColumn("stint_no", F.sum("_new").over(
                order.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
            .drop("_new"))


def entity_order(entity: str, season: str):
    return W.partitionBy(entity).orderBy(season)


def same_value(entity: str, season: str, column: str) -> Column:
    """The column equals its value in the entity's previous row."""
    return F.col(column) == F.lag(column).over(entity_order(entity, season))


def stint_islands(df: DataFrame, entity: str, season: str, dims: list[str] | None = None,
                  either: bool = False) -> DataFrame:
    """One row per stint: start, end, seasons, duration and the first value of each dim.

    With several ``dims`` a stint continues when all match, or any one if ``either``.
    """
    same = None
    for d in dims or []:
        this = F.coalesce(same_value(entity, season, d), F.lit(False))
        same = this if same is None else (same | this if either else same & this)
    marked = number_islands(df, entity, season, same)
    return (marked.groupBy(entity, "stint_no")
            .agg(F.min(season).alias("start_season"), F.max(season).alias("end_season"),
                 F.count(F.lit(1)).alias("n_seasons"),
                 *[F.min_by(d, season).alias(d) for d in dims or []])
            .withColumn("duration", (F.col("end_season") - F.col("start_season") + 1).cast("int")))


def run_islands(df: DataFrame, keys: list[str], season: str) -> DataFrame:
    """Consecutive-season runs of each key combination as (keys, run_start, run_end)."""
    order = W.partitionBy(*keys).orderBy(season)
    return (df.select(*keys, season).distinct()
            .withColumn("_grp", F.col(season) - F.row_number().over(order))
            .groupBy(*keys, "_grp")
            .agg(F.min(season).alias("run_start"), F.max(season).alias("run_end"))
            .drop("_grp"))


def tenure_run_forward(anchors: DataFrame, history: DataFrame, keys: list[str], anchor: str,
                       season: str, name: str = "tenure") -> DataFrame:
    """Consecutive seasons from the anchor with the same keys; NULL when it has none."""
    return _run(anchors, history, keys, F.col(anchor), season,
                F.col("run_end") - F.col(anchor) + 1, name)


def run_backward(anchors: DataFrame, history: DataFrame, keys: list[str], anchor: str,
                 season: str, name: str = "run_length") -> DataFrame:
    """Consecutive seasons with the same keys that end just before the anchor, else 0."""
    out = _run(anchors, history, keys, F.col(anchor) - 1, season,
               F.col(anchor) - F.col("run_start"), name)
    return out.withColumn(name, F.coalesce(name, F.lit(0)))


def _run(anchors, history, keys, at, season, length, name):
    runs = run_islands(history, keys, season)
    runs = runs.select(*[F.col(k).alias(f"_{k}") for k in keys], "run_start", "run_end")
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    on.append(at.between(F.col("run_start"), F.col("run_end")))
    return (anchors.join(runs, on, "left")
            .withColumn(name, length.cast("int"))
            .drop("run_start", "run_end", *[f"_{k}" for k in keys]))


def dedupe_keep_first(df: DataFrame, keys: list[str], order: list[str],
                      keep_all: Column) -> DataFrame:
    """One row per key, the first in ``order``; rows where ``keep_all`` holds all stay.

    ``min_by`` aggregates combine before the shuffle, so a key with very many copies costs
    one row per map task instead of a sort of all copies.
    """
    rest = [c for c in df.columns if c not in keys]
    once = df.filter(~keep_all).groupBy(*keys)
    if rest == order and len(order) == 1:
        kept = once.agg(F.min(order[0]).alias(order[0]))
    else:
        kept = once.agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
    return kept.select(df.columns).unionByName(df.filter(keep_all))


def cumulative_snapshot(per_season: DataFrame, entity: str, season: str,
                        counters: dict[str, Column], means: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Counters and pooled means as they stood before each season of the entity.

    ``means`` maps a name to (sum, count) expressions per season, so a mean pools records
    rather than seasons.
    """
    before = entity_order(entity, season).rowsBetween(W.unboundedPreceding, -1)
    out = [F.coalesce(F.sum(e).over(before), F.lit(0)).alias(n) for n, e in counters.items()]
    for n, (total, cnt) in means.items():
        out.append(F.try_divide(F.sum(total).over(before), F.sum(cnt).over(before)).alias(n))
    return per_season.select(entity, season, *out)


def prior_stint_count(stints: DataFrame, entity: str, start: str = "start_season") -> DataFrame:
    """Number of earlier stints of the entity."""
    order = W.partitionBy(entity).orderBy(start)
    return stints.withColumn("prior_stints", (F.row_number().over(order) - 1).cast("int"))


def gap_before(df: DataFrame, entity: str, season: str) -> DataFrame:
    """Inactive seasons since the entity's previous active one."""
    prev = F.lag(season).over(entity_order(entity, season))
    return df.withColumn("gap", (F.col(season) - prev - 1).cast("int"))


def close_previous(stints: DataFrame, entity: str, start: str = "start_season",
                   end: str = "end_season") -> DataFrame:
    """Length of a stint as closed by its successor: up to the next start unless a gap came first."""
    nxt = F.lead(start).over(W.partitionBy(entity).orderBy(start))
    return (stints.withColumn("next_start", nxt)
            .withColumn("closed_length",
                        (F.least(F.col(end) + 1, F.coalesce("next_start", F.col(end) + 1))
                         - F.col(start)).cast("int")))


def season_number_cumsum(per_season: DataFrame, entity: str, season: str, measure: str,
                         first_n: int | None = None) -> DataFrame:
    """Season index and cumulative measure per entity, optionally the first n seasons."""
    order = entity_order(entity, season)
    out = (per_season.withColumn("season_no", F.row_number().over(order))
           .withColumn("cum_measure", F.sum(measure).over(
               order.rowsBetween(W.unboundedPreceding, 0))))
    return out if first_n is None else out.filter(F.col("season_no") <= first_n)


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per group; the rank filter is pushed below the shuffle by Spark."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= n)


def mode_per_group(df: DataFrame, group: list[str], label: str, name: str = "modal") -> DataFrame:
    """Most frequent label per group, the smallest on ties."""
    counts = df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("_n"))
    # Larger count first, then the smaller label: min over (-n, label).
    return (counts.groupBy(*group)
            .agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col(label).alias("l"))).alias("_b"),
                 F.sum("_n").alias("n_rows"))
            .select(*group, F.col("_b.l").alias(name), (-F.col("_b.m")).alias("modal_count"), "n_rows"))


def age_carry(df: DataFrame, age: Column, first_age: Column, years_since: Column) -> DataFrame:
    """Recorded age, else the first known age plus the seasons since."""
    return df.withColumn("age_at", F.coalesce(age, first_age + years_since))


def step_read(points: DataFrame, at: str, curve: DataFrame, time: str, value: str,
              keys: list[str] | None = None, empty: float = 0.0) -> DataFrame:
    """Value of a step function at each point: last step at or before it, else ``empty``.

    A curve has one row per distinct season. With keys it is turned into half-open intervals
    [time, next time), so the join keeps at most one step per point; without keys the whole
    curve is one small array next to every point and no join is needed.
    """
    keys = keys or []
    if not keys:
        pairs = curve.agg(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("v")))).scalar()
        last = F.array_max(F.filter("_curve", lambda p: p["t"] <= F.col(at)))
        return (points.withColumn("_curve", pairs)
                .withColumn(value, F.coalesce(last.getField("v"), F.lit(empty))).drop("_curve"))
    order = W.partitionBy(*keys).orderBy(time)
    steps = curve.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(time).alias("_from"),
                         F.lead(time).over(order).alias("_to"), F.col(value).alias(f"_{value}"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    on += [F.col(at) >= F.col("_from"), F.col("_to").isNull() | (F.col(at) < F.col("_to"))]
    return (points.join(steps, on, "left")
            .withColumn(value, F.coalesce(f"_{value}", F.lit(empty)))
            .drop("_from", "_to", f"_{value}", *[f"_{k}" for k in keys]))
