"""Concordance without forming pairs.

A pair (i, j) is comparable when i had the event and j's time code is larger. Write each
time code in binary: the codes of i and j first differ at exactly one bit, where i has 0 and
j has 1, and agree on the prefix above. So each row is sent once per bit level to the group
(level, prefix), and within a group every row with bit 1 outlives every row with bit 0. Per
group the scores are counted by running sums. That is rows x log2(time range) instead of
rows squared, exact, and the score order is cut into ranges so no group meets in one task.

With few distinct times a row is sent once: scores travel packed to the ranges of their order (``packed``), a
range counts its pairs for each time (``time_pairs``), and pairs across ranges follow from the ranges' counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellkit.functions.numeric import safe_div
from dwellkit.operators.running import running
from dwellkit.session import materialized


def pair_counts(df: DataFrame, code: Column, anchor: Column, score: str,
                weight: Column | None = None, bits: int | None = None, by: list[str] | None = None) -> DataFrame:
    """One row (per ``by`` group): weighted comparable, concordant and tied pairs.

    ``code`` is a non-negative integer, larger for the later time; ``anchor`` marks rows
    that may be the earlier member; ``weight`` multiplies an anchor's pairs.
    """
    by = by or []
    cells = (df.select(*by, code.cast("bigint").alias("_code"), anchor.alias("_anchor"),
                       F.col(score).cast("double").alias("_score"),
                       (F.lit(1.0) if weight is None else weight).alias("_w"))
             .filter(F.col("_score").isNotNull())
             .groupBy(*by, "_code", "_anchor", "_score", "_w").agg(F.count(F.lit(1)).alias("_n")))
    cells = materialized(cells)  # read for the largest code and for the pairs
    if bits is None:
        # Bit levels up to the largest code, found while the job runs.
        top = cells.agg(F.greatest(F.max("_code"), F.lit(1))).scalar()
        last = F.length(F.bin(top)) - 1
    else:
        last = F.lit(bits - 1)
    at = cells.withColumn("_level", F.explode(F.sequence(F.lit(0), last)))
    at = (at.withColumn("_prefix", F.expr("shiftright(_code, _level + 1)"))
          .withColumn("_later", F.expr("shiftright(_code, _level) & 1") == 1))
    per = at.groupBy(*by, "_level", "_prefix", "_score").agg(
        F.sum(F.when(F.col("_later"), F.col("_n")).otherwise(0)).alias("_nj"),
        F.sum(F.when(~F.col("_later") & F.col("_anchor"), F.col("_n") * F.col("_w"))
              .otherwise(0.0)).alias("_wi"))
    run = running(per, "_score", {"_j": F.col("_nj")}, [*by, "_level", "_prefix"])
    above = F.col("_j_total") - F.col("_j_before") - F.col("_nj")
    return run.groupBy(*by).agg(F.sum(F.col("_wi") * F.col("_j_total")).alias("comparable"),
                                F.sum(F.col("_wi") * above).alias("concordant"),
                                F.sum(F.col("_wi") * F.col("_nj")).alias("tied"))


def _index(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.withColumn(name, safe_div(F.col("concordant") + 0.5 * F.col("tied"), F.col("comparable")))


def harrell(df: DataFrame, time: str, event: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Harrell's C; a higher score means a longer time. Whole-number times.

    Equal times are comparable when the other one is censored: the code is twice the time,
    plus one for a censored row.
    """
    code = F.col(time) * 2 + (1 - F.col(event))
    return _index(pair_counts(df, code, F.col(event) == 1, score, by=by), "c_index")


def uno(df: DataFrame, time: str, event: str, score: str, g_curve: DataFrame,
        tau: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Uno's C: later times strictly larger, anchors up to tau, weight 1 / G(T)^2.

    ``g_curve`` has one row per time (and ``by`` group). Without ``tau`` it is the largest
    event time, which every anchor satisfies. A time that G lacks reads the last one before.
    """
    from dwellkit.operators.stints import step_read

    by = by or []
    times = df.select(*by, time).distinct()
    g = step_read(times, time, g_curve.withColumnRenamed(time, "_gt"), "_gt", "g", by, empty=1.0)
    g = g.select(*by, time, F.col("g").alias("_g"))
    tau = F.lit(float("inf")) if tau is None else tau
    rows = (df.join(g, [*by, time])
            .withColumn("_anchor_row", (F.col(event) == 1) & (F.col(time) <= tau))
            .withColumn("_weight", F.lit(1.0) / F.pow(F.greatest("_g", F.lit(1e-8)), 2)))
    pairs = pair_counts(rows, F.col(time), F.col("_anchor_row"), score, F.col("_weight"), by=by)
    return _index(pairs, "c_uno")


#: Distinct times up to which pairs are counted for each time, rows of one range of scores, and rows that the ranges are learned from.
FEW_TIMES, RANGE_ROWS, CUT_ROWS = 64, 1 << 18, 1 << 14
PACKED = "grp long, range int, s binary, c binary, n binary"


def few_times(rows: DataFrame, time: str) -> np.ndarray | None:
    """The distinct times in order, or None where they are more than FEW_TIMES."""
    found = rows.select(F.col(time).cast("double").alias("t")).distinct().limit(FEW_TIMES + 1).collect()
    return np.sort([r["t"] for r in found]) if len(found) <= FEW_TIMES else None


def packed(group: int, score: np.ndarray, code: np.ndarray, cuts: np.ndarray) -> Iterator[tuple]:
    """Rows of PACKED: the rows of each range of the scores in order, rows with equal score and code as one where that is shorter.

    A code is twice the number of the time, plus one for a censored row.
    """
    order = np.argsort(score, kind="stable")
    s, c, n = score[order], code[order].astype(np.uint8), None
    distinct = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
    if len(s) > 4 * FEW_TIMES * (distinct[-1] + 1):
        table = np.bincount(distinct * 2 * FEW_TIMES + c)
        cells = np.flatnonzero(table)
        s, c = s[np.searchsorted(distinct, cells // (2 * FEW_TIMES))], (cells % (2 * FEW_TIMES)).astype(np.uint8)
        n = table[cells].astype(np.int64)
    ends = [0, *np.searchsorted(s, cuts).tolist(), len(s)]
    for r, (a, b) in enumerate(zip(ends, ends[1:])):
        if a < b:
            yield group, r, s[a:b].tobytes(), c[a:b].tobytes(), None if n is None else n[a:b].tobytes()


def _pairs_inside(s: np.ndarray, c: np.ndarray, n: np.ndarray, n_times: int) -> np.ndarray:
    """[4, time of the anchor]: concordant and tied pairs, the later row by code or by time alone."""
    order = np.argsort(s, kind="stable")
    s, c, n = s[order], c[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    group = np.repeat(np.arange(len(first)), np.diff([*first, len(s)]))
    out = np.zeros((4, n_times), np.int64)
    for i in range(n_times):
        anchors = np.flatnonzero(c == 2 * i)
        if not len(anchors):
            continue
        weight, at = n[anchors], group[anchors]
        for j, code in enumerate((2 * i, 2 * i + 1)):
            own = np.add.reduceat(np.where(c > code, n, 0), first)
            upto = np.cumsum(own)
            out[2 * j, i], out[2 * j + 1, i] = weight @ (upto[-1] - upto[at]), weight @ own[at]
    return out


def time_pairs(rows: DataFrame, times: np.ndarray) -> DataFrame:
    """(grp, t, and comparable, concordant and tied pairs of the events at t): h_* as ``harrell`` counts them, u_* as ``uno`` does without weights.

    ``rows`` are PACKED. A range of scores meets in one task; of all ranges only the numbers of their codes meet.
    """
    k = len(times)

    def inside(key: tuple, table: pa.Table) -> pa.Table:
        s, c = (np.frombuffer(b"".join(table[x].to_pylist()), kind) for x, kind in (("s", np.float64), ("c", np.uint8)))
        n = np.concatenate([np.ones(len(t), np.int64) if b is None else np.frombuffer(b, np.int64)
                            for t, b in zip(table["c"].to_pylist(), table["n"].to_pylist())])
        codes = np.zeros(2 * k, np.int64)
        np.add.at(codes, c, n)
        return pa.table({"grp": [key[0].as_py()], "range": pa.array([key[1].as_py()], pa.int32()), "codes": [codes.tolist()],
                         "pairs": [_pairs_inside(s, c, n, k).ravel().tolist()]})

    def across(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["range"].to_numpy())
        codes, pairs = (np.array(table[x].to_pylist(), np.int64)[order] for x in ("codes", "pairs"))
        out = pairs.sum(0).reshape(2, 2, k)
        # Rows beyond each code, in the ranges above and in all.
        beyond = np.cumsum(codes[:, ::-1], axis=1)[:, ::-1] - codes
        above, anchors = np.cumsum(beyond[::-1], axis=0)[::-1] - beyond, codes[:, ::2]
        columns = {"grp": pa.array([key[0].as_py()] * k), "t": pa.array(times)}
        for j, name in enumerate("hu"):
            columns[f"{name}_comparable"] = pa.array(anchors.sum(0) * beyond.sum(0)[j::2])
            columns[f"{name}_concordant"] = pa.array(out[j, 0] + (anchors * above[:, j::2]).sum(0))
            columns[f"{name}_tied"] = pa.array(out[j, 1])
        return pa.table(columns)
    parts = rows.groupBy("grp", "range").applyInArrow(inside, "grp long, range int, codes array<long>, pairs array<long>")
    counts = ", ".join(f"{x}_{c} long" for x in "hu" for c in ("comparable", "concordant", "tied"))
    return parts.groupBy("grp").applyInArrow(across, f"grp long, t double, {counts}")


def harrell_of_times(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``harrell`` from ``time_pairs``."""
    return _index(pairs.groupBy(*by).agg(*[F.sum(f"h_{c}").alias(c) for c in ("comparable", "concordant", "tied")]), "c_index")


def uno_of_times(pairs: DataFrame, time: str, g_curve: DataFrame, by: list[str]) -> DataFrame:
    """``uno`` from ``time_pairs``, without ``tau``."""
    from dwellkit.operators.stints import step_read

    g = step_read(pairs, time, g_curve.withColumnRenamed(time, "_gt"), "_gt", "g", by, empty=1.0)
    weight = F.lit(1.0) / F.pow(F.greatest("g", F.lit(1e-8)), 2)
    return _index(g.groupBy(*by).agg(*[F.sum(F.col(f"u_{c}") * weight).alias(c) for c in ("comparable", "concordant", "tied")]), "c_uno")
