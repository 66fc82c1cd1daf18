"""Unit-season rows: what each supplier shipped in a year, on two sides.

The own side are lines that were kept, the opposing side lines that were returned.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellkit.plans.base import table

STATS = ["price", "quantity", "discount", "tax", "n_lines"]


def unit_sides(spark, sf):
    """(unit, season, side, price, quantity, discount, tax, n_lines), map-side combined."""
    li = table(spark, sf, "lineitem")
    return (li.groupBy(F.col("l_suppkey").alias("unit"), F.year("l_shipdate").alias("season"),
                       F.when(F.col("l_returnflag") == "R", "opp").otherwise("own").alias("side"))
            .agg(F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"),
                 F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"),
                 F.count(F.lit(1)).alias("n_lines")))


def unit_seasons(spark, sf):
    """One row per (unit, season) over both sides."""
    li = table(spark, sf, "lineitem")
    returned = F.col("l_returnflag") == "R"
    return (li.groupBy(F.col("l_suppkey").alias("unit"), F.year("l_shipdate").alias("season"))
            .agg(F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"),
                 F.sum(F.when(returned, F.col("l_extendedprice"))).alias("price_opp"),
                 F.avg("l_discount").alias("discount"), F.count(F.lit(1)).alias("n_lines"),
                 F.count_if(returned).alias("n_returned")))


SIDES_SQL = """SELECT l_suppkey AS unit, CAST(year(l_shipdate) AS INTEGER) AS season,
  CASE WHEN l_returnflag = 'R' THEN 'opp' ELSE 'own' END AS side, sum(l_extendedprice) AS price,
  sum(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax, count(*) AS n_lines
  FROM lineitem GROUP BY 1, 2, 3"""
UNITS_SQL = """SELECT l_suppkey AS unit, CAST(year(l_shipdate) AS INTEGER) AS season,
  sum(l_extendedprice) AS price, sum(l_quantity) AS quantity,
  sum(l_extendedprice) FILTER (l_returnflag = 'R') AS price_opp, avg(l_discount) AS discount,
  count(*) AS n_lines, count(*) FILTER (l_returnflag = 'R') AS n_returned FROM lineitem GROUP BY 1, 2"""
