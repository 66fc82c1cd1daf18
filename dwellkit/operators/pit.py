"""Point-in-time joins: a row may only see what happened strictly before its anchor.

History is first reduced to one row per (entity, season). Each season row then carries the
half-open validity interval in which it is the latest known one, so an anchor meets at most
one row and no per-anchor aggregation over the past is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def known_until(per_season: DataFrame, keys: list[str], season: str) -> DataFrame:
    """Add ``_seen`` (the season) and ``_next`` (the key's next season, NULL for the last)."""
    order = W.partitionBy(*keys).orderBy(season)
    return per_season.withColumn("_seen", F.col(season)).withColumn("_next", F.lead(season).over(order))


def asof_before(anchors: DataFrame, per_season: DataFrame, keys: list[str], anchor: str,
                season: str, attributes: list[str], prefix: str = "last_") -> DataFrame:
    """Attributes of the latest season strictly before the anchor, NULL when there is none."""
    known = known_until(per_season, keys, season).select(
        *[F.col(k).alias(f"_{k}") for k in keys], "_seen", "_next",
        *[F.col(a).alias(f"{prefix}{a}") for a in attributes])
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    on += [F.col("_seen") < F.col(anchor), F.col("_next").isNull() | (F.col("_next") >= F.col(anchor))]
    return anchors.join(known, on, "left").drop("_seen", "_next", *[f"_{k}" for k in keys])


def pit_features(anchors: DataFrame, per_season: DataFrame, keys: list[str], anchor: str, season: str,
                 sums: dict[str, Column], latest: list[str] | None = None) -> DataFrame:
    """Running sums of the past as known at the anchor (0 when there is no past)."""
    upto = W.partitionBy(*keys).orderBy(season).rowsBetween(W.unboundedPreceding, 0)
    run = per_season.select(*keys, season, *(latest or []),
                            *[F.sum(e).over(upto).alias(n) for n, e in sums.items()])
    out = asof_before(anchors, run, keys, anchor, season, [*sums, *(latest or [])], prefix="_p_")
    for n in sums:
        out = out.withColumn(n, F.coalesce(f"_p_{n}", F.lit(0))).drop(f"_p_{n}")
    for n in latest or []:
        out = out.withColumnRenamed(f"_p_{n}", f"last_{n}")
    return out


def lag_season(df: DataFrame, attributes: DataFrame, keys: list[str], season: str, columns: list[str],
               lag: int = 1, prefix: str = "prev_") -> DataFrame:
    """Attributes of the same unit exactly ``lag`` seasons earlier."""
    prev = attributes.select(*keys, (F.col(season) + lag).alias(season),
                             *[F.col(c).alias(prefix + c) for c in columns])
    return df.join(prev, [*keys, season], "left")


def lookback_mean(anchors: DataFrame, per_season: DataFrame, keys: list[str], anchor: str, season: str,
                  means: dict[str, Column], offsets: tuple[int, ...] = (1, 2),
                  counts: dict[str, Column] | None = None) -> DataFrame:
    """Averages over the seasons at ``anchor - offset``, and counts of seasons meeting a condition.

    The seasons are shifted forward instead of the anchors back, so the join is a plain
    equality on (keys, anchor) and each season row is copied once per offset.
    """
    shifted = (per_season.withColumn("_off", F.explode(F.array(*[F.lit(o) for o in offsets])))
               .withColumn(anchor, F.col(season) + F.col("_off")))
    agg = [F.avg(e).alias(n) for n, e in means.items()]
    agg += [F.count_if(e).alias(n) for n, e in (counts or {}).items()]
    seen = shifted.groupBy(*keys, anchor).agg(*agg)
    out = anchors.join(seen, [*keys, anchor], "left")
    for n in counts or {}:
        out = out.withColumn(n, F.coalesce(n, F.lit(0)))
    return out


def forward_mean(anchors: DataFrame, per_season: DataFrame, keys: list[str], anchor: str, season: str,
                 value: Column, recent_from: int, span: int = 2, sentinel: float = -1.0) -> DataFrame:
    """Mean of the value over the anchor and the following seasons.

    A recent anchor that lacks some of them gets its single value, or the sentinel when
    there is none.
    """
    back = tuple(-o for o in range(span))
    out = lookback_mean(anchors, per_season, keys, anchor, season,
                        {"forward_mean": value}, back, {"n_forward": value.isNotNull()})
    recent = (F.col(anchor) >= recent_from) & (F.col("n_forward") < span)
    return out.withColumn("forward_mean", F.when(recent, F.coalesce("forward_mean", F.lit(sentinel)))
                          .otherwise(F.col("forward_mean")))


def member_before(anchors: DataFrame, membership: DataFrame, keys: list[str], anchor: str,
                  season: str, name: str = "was_member") -> DataFrame:
    """1 where the anchor's keys were active in the season just before it."""
    prior = (membership.select(*keys, (F.col(season) + 1).alias(anchor)).distinct()
             .withColumn("_hit", F.lit(1)))
    return (anchors.join(prior, [*keys, anchor], "left")
            .withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_hit"))


def interval_contains(points: DataFrame, spans: DataFrame, keys: list[str], at: str,
                      start: str = "start_season", end: str = "end_season",
                      carry: list[str] | None = None) -> DataFrame:
    """The first span of the key that contains the point; ``matched`` is false without one.

    Spans are expanded to their seasons (a span is bounded by the study length), which makes
    this an equality join on (key, season); overlapping spans resolve to the earliest.
    """
    carry = carry or []
    cells = (spans.select(*keys, start, end, *carry, F.explode(F.sequence(start, end)).alias(at))
             .groupBy(*keys, at).agg(F.min(F.struct(start, end, *carry)).alias("_s")))
    return (points.join(cells, [*keys, at], "left")
            .select(*points.columns, "_s.*", F.col("_s").isNotNull().alias("matched")))


def spans_of_points(spans: DataFrame, points: DataFrame, at: str, span_id: list[str],
                    start: str = "start_season", end: str = "end_season") -> DataFrame:
    """How many points fall into each span and which comes first (no key but time).

    Points are summed up per season before they meet the expanded spans.
    """
    per = points.groupBy(at).agg(F.count(F.lit(1)).alias("_n"))
    cells = spans.select(*span_id, F.explode(F.sequence(start, end)).alias(at))
    hit = cells.join(per, at).groupBy(*span_id).agg(
        F.sum("_n").alias("n_points"), F.min(at).alias("first_point"))
    return (spans.join(hit, span_id, "left")
            .withColumn("n_points", F.coalesce("n_points", F.lit(0))))
