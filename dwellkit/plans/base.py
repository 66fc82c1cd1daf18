"""The panel every job starts from, in Spark and as SQL.

``orders`` is the history: entity = customer, season = order year. A season row sums up the
orders of an entity in a year; a stint is a run of consecutive seasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellkit.functions.numeric import nan_to_null
from dwellkit.operators import stints as st


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; a NaN in it is a missing value."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.withColumns({c: nan_to_null(F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def history(spark, sf) -> DataFrame:
    """Record-level history."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("season"),
        F.col("o_orderkey").alias("record"), F.col("o_orderdate").alias("placed"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"))


def record_order() -> Column:
    """Day, then record number, as one long: an aggregate ordered by it stays a hash aggregate."""
    return F.unix_date(F.col("placed").cast("date")).cast("bigint") * F.lit(2 ** 47) + F.col("record")


def seasons(spark, sf) -> DataFrame:
    """One row per (entity, season); only the measures a job uses are computed.

    The last status and priority are aggregated as positions in their short closed lists and
    turned back into text afterwards: numbers keep the aggregate hash-based, text would make
    it sort all records.
    """
    last, hist = F.col("_order"), history(spark, sf)
    lists = {c: hist.agg(F.sort_array(F.collect_set(c))).scalar() for c in ("status", "priority")}

    def code(c):
        return F.array_position(lists[c], F.col(c)).cast("int")

    out = hist.withColumn("_order", record_order()).groupBy("entity", "season").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("status") == "F").alias("w"),
        F.count_if(F.col("status") == "O").alias("l"),
        F.count_if(F.col("status") == "P").alias("t"),
        F.sum("price").alias("spend"),
        F.max_by((F.col("status") == "P").cast("int"), last).alias("last_is_p"),
        F.max_by(code("status"), last).alias("_status"), F.max_by(code("priority"), last).alias("_priority"))
    return out.select(*[c for c in out.columns if not c.startswith("_")],
                      F.element_at(lists["status"], F.col("_status")).alias("last_status"),
                      F.element_at(lists["priority"], F.col("_priority")).alias("last_priority"))


def stints(spark, sf) -> DataFrame:
    """entity, stint_no, start_season, end_season, n_seasons, duration."""
    return st.stint_islands(st.seasons_of(history(spark, sf), "entity", "season"), "entity", "season")


def targets(spark, sf) -> DataFrame:
    """Stints with cause (0 open at the boundary, 1 event, 2 competing) and event flag.

    One pass over the season rows: the last season's status travels with the island.
    """
    per = seasons(spark, sf)
    marked = st.number_islands(per, "entity", "season")
    boundary = history(spark, sf).agg(F.max("season").alias("b")).scalar()
    out = marked.groupBy("entity", "stint_no").agg(
        F.min("season").alias("start_season"), F.max("season").alias("end_season"),
        F.max_by("last_is_p", "season").alias("last_is_p"))
    cause = (F.when(F.col("end_season") >= boundary, 0)
             .when(F.col("last_is_p") == 1, 2).otherwise(1))
    return (out.withColumn("duration", (F.col("end_season") - F.col("start_season") + 1).cast("int"))
            .withColumn("cause", cause)
            .withColumn("event", (F.col("cause") == 1).cast("int"))
            .withColumn("label", F.when(F.col("duration") <= 2, 0)
                        .when(F.col("duration") <= 4, 1).otherwise(2))
            .select("entity", "stint_no", "start_season", "end_season", "duration", "cause", "event", "label"))


FEATURES = ["prior_orders", "prior_spend", "mean_price", "gap", "acctbal", "nation"]


def features(spark, sf) -> DataFrame:
    """Targets plus what was known before each stint began (NULL where there was nothing)."""
    per = seasons(spark, sf)
    w = st.entity_order("entity", "season").rowsBetween(W.unboundedPreceding, -1)
    prev = F.lag("season").over(st.entity_order("entity", "season"))
    known = per.select(
        "entity", "season",
        F.coalesce(F.sum("n_rows").over(w), F.lit(0)).cast("double").alias("prior_orders"),
        (F.coalesce(F.sum("spend").over(w), F.lit(0.0)) / 100000.0).alias("prior_spend"),
        (F.sum("spend").over(w) / F.sum("n_rows").over(w) / 100000.0).alias("mean_price"),
        (F.col("season") - prev - 1).cast("double").alias("gap"))
    cust = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("_cust"), (F.col("c_acctbal") / 1000.0).alias("acctbal"),
        F.col("c_nationkey").cast("double").alias("nation"))
    t = targets(spark, sf)
    return (t.join(known, (t.entity == known.entity) & (t.start_season == known.season))
            .drop(known.entity, known.season)
            .join(cust, F.col("entity") == F.col("_cust"), "left").drop("_cust"))


# ---------------------------------------------------------------- the same in SQL

CTES = {
    "history": """SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS season,
        o_orderkey AS record, o_orderdate AS placed, o_orderstatus AS status,
        o_orderpriority AS priority, o_totalprice AS price FROM orders""",
    "seasons": """SELECT entity, season, count(*) AS n_rows,
        count(*) FILTER (status = 'F') AS w, count(*) FILTER (status = 'O') AS l,
        count(*) FILTER (status = 'P') AS t, sum(price) AS spend,
        last(status ORDER BY placed, record) AS last_status,
        last(priority ORDER BY placed, record) AS last_priority
        FROM history GROUP BY entity, season""",
    "boundary": "SELECT max(season) AS b FROM history",
    "marked": """SELECT *, CAST(season - row_number() OVER (PARTITION BY entity ORDER BY season) AS INTEGER) AS grp
        FROM seasons""",
    "stints": """SELECT entity, CAST(row_number() OVER (PARTITION BY entity ORDER BY min(season)) AS INTEGER) AS stint_no,
        min(season) AS start_season, max(season) AS end_season, count(*) AS n_seasons,
        CAST(max(season) - min(season) + 1 AS INTEGER) AS duration, arg_max(last_status, season) AS last_status
        FROM marked GROUP BY entity, grp""",
    "targets": """SELECT entity, stint_no, start_season, end_season, duration,
        CASE WHEN end_season >= (SELECT b FROM boundary) THEN 0 WHEN last_status = 'P' THEN 2 ELSE 1 END AS cause,
        CASE WHEN end_season >= (SELECT b FROM boundary) THEN 0 WHEN last_status = 'P' THEN 0 ELSE 1 END AS event,
        CASE WHEN duration <= 2 THEN 0 WHEN duration <= 4 THEN 1 ELSE 2 END AS label
        FROM stints""",
    "known": """SELECT entity, season,
        CAST(coalesce(sum(n_rows) OVER w, 0) AS DOUBLE) AS prior_orders,
        coalesce(sum(spend) OVER w, 0) / 100000.0 AS prior_spend,
        sum(spend) OVER w / sum(n_rows) OVER w / 100000.0 AS mean_price,
        CAST(season - lag(season) OVER (PARTITION BY entity ORDER BY season) - 1 AS DOUBLE) AS gap
        FROM seasons
        WINDOW w AS (PARTITION BY entity ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "features": """SELECT t.*, k.prior_orders, k.prior_spend, k.mean_price, k.gap,
        c_acctbal / 1000.0 AS acctbal, CAST(c_nationkey AS DOUBLE) AS nation
        FROM targets t JOIN known k ON t.entity = k.entity AND t.start_season = k.season
        LEFT JOIN customer ON c_custkey = t.entity""",
}
NEEDS = {"seasons": ["history"], "boundary": ["history"], "marked": ["seasons"],
         "stints": ["marked"], "targets": ["stints", "boundary"], "known": ["seasons"],
         "features": ["targets", "known"]}


def sql(body: str, *names: str, **extra: str) -> str:
    """``WITH`` the named base tables (and their needs) and ``extra`` ones, then ``body``."""
    seen: list[str] = []

    def visit(name):
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in seen:
            seen.append(name)
    for name in names:
        visit(name)
    parts = [f"{n} AS ({CTES[n]})" for n in seen] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def rnd(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"
