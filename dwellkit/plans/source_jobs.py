"""Jobs that read and write files, take rows out of pages, and run streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dwellkit.functions.numeric import rounded
from dwellkit.operators.aggregates import zscore_by_period
from dwellkit.plans.base import rnd, seasons, sql, table, targets
from dwellkit.plans.registry import job
from dwellkit.plans.units import UNITS_SQL, unit_seasons
from dwellkit.session import checkpoint_root
from dwellkit.sources import files, pages
from dwellkit.streaming import events as ev


def _folder(spark, what):
    return f"{checkpoint_root(spark)}/{what}-{uuid.uuid4().hex}"


@job("scan_entity_dirs", """
SELECT CAST(c_nationkey AS VARCHAR) AS entity, CAST(year(o_orderdate) AS INTEGER) AS "Year", count(*) AS n, count(DISTINCT o_orderpriority) AS n_roles
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def scan_entity_dirs(spark, sf):
    """One directory of history files per nation, then read back by directory name."""
    nation = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity"))
    rows = table(spark, sf, "orders").join(nation, "o_custkey").select(
        "entity", F.year("o_orderdate").alias("Year"), F.col("o_orderstatus").alias("Level"), F.col("o_orderpriority").alias("Role"))
    root = _folder(spark, "entities")
    rows.write.partitionBy("entity").option("header", True).csv(root)
    back = files.read_entity_dirs(spark, root, "*.csv", "Year int, Level string, Role string")
    return back.groupBy("entity", "Year").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("Role").alias("n_roles"))


@job("scan_header_variants", """
SELECT CAST(c_nationkey AS VARCHAR) AS entity, CAST(year(o_orderdate) AS INTEGER) AS "Year", count(*) AS n,
  count(CASE WHEN year(o_orderdate) < 1997 THEN o_orderpriority END) AS n_roles, count(CASE WHEN year(o_orderdate) >= 1997 THEN 1 END) AS n_levels
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def scan_header_variants(spark, sf):
    """History files with two headers in one tree: older ones lack a column and have another order."""
    nation = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity"))
    rows = table(spark, sf, "orders").join(nation, "o_custkey").select(
        "entity", F.year("o_orderdate").alias("Year"), F.col("o_orderpriority").alias("Role"), F.col("o_orderstatus").alias("Level"))
    root = _folder(spark, "variants")
    for part in (rows.filter("Year < 1997").select("entity", "Role", "Year"), rows.filter("Year >= 1997").select("entity", "Year", "Level")):
        part.hint("rebalance", F.col("entity")).write.mode("append").partitionBy("entity").option("header", True).csv(root)
    back = files.read_by_header(spark, root, "*.csv", {"Year": "int", "Role": "string", "Level": "string"})
    return back.groupBy("entity", "Year").agg(F.count(F.lit(1)).alias("n"), F.count("Role").alias("n_roles"), F.count("Level").alias("n_levels"))


@job("scan_union_by_name", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS price, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS priority,
  CASE WHEN o_orderstatus = 'P' THEN 'p' END AS extra FROM orders""")
def scan_union_by_name(spark, sf):
    o = table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    return files.union_variants([
        o.filter(status == "F").select("o_orderkey", F.col("o_totalprice").alias("price")),
        o.filter(status == "O").select("o_orderkey", F.col("o_orderpriority").alias("priority")),
        o.filter(status == "P").select(F.lit("p").alias("extra"), F.col("o_orderpriority").alias("priority"), "o_orderkey")])


@job("scan_partition_pruned", f"""SELECT o_orderstatus, count(*) AS n, {rnd('sum(o_totalprice)', 2)} AS total FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1""")
def scan_partition_pruned(spark, sf):
    root = _folder(spark, "seasons")
    files.write_by_season(table(spark, sf, "orders").withColumn("season", F.year("o_orderdate")), root, "season")
    return files.read_season(spark, root, "season", 1997).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"))


@job("sink_partitioned", sql(f"""
SELECT 'raw' AS kind, season, count(*) AS n, {rnd('sum(price)', 2)} AS total FROM units GROUP BY 1, 2
UNION ALL SELECT 'normalized', season, count(*), {rnd('sum(abs(z))', 4)} FROM (SELECT season, (price - avg(price) OVER w) / stddev_pop(price) OVER w AS z FROM units WINDOW w AS (PARTITION BY season)) GROUP BY 1, 2""", units=UNITS_SQL))
def sink_partitioned(spark, sf):
    u = unit_seasons(spark, sf).select("unit", "season", "price", "n_lines")
    both = u.withColumn("kind", F.lit("raw")).unionByName(
        zscore_by_period(u, "season", ["price"]).withColumn("kind", F.lit("normalized")))
    root = _folder(spark, "league")
    files.write_by_season(both, root, "season", "kind")
    back = spark.read.parquet(root)
    raw = F.col("kind") == "raw"
    return back.groupBy("kind", "season").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("_s"), F.sum(F.abs("price")).alias("_a")).select(
        "kind", "season", "n", F.when(raw, rounded(F.col("_s"), 2)).otherwise(rounded(F.col("_a"), 4)).alias("total"))


@job("sink_modeling_table", sql("SELECT entity, start_season, duration, CASE WHEN cause = 0 THEN -1 ELSE label END AS label FROM targets WHERE cause <> 0", "targets"))
def sink_modeling_table(spark, sf):
    t = targets(spark, sf).select(F.monotonically_increasing_id().alias("Unnamed: 0"), "entity", "start_season", "duration",
                                  F.when(F.col("cause") == 0, -1).otherwise(F.col("label")).alias("label"))
    path = _folder(spark, "modeling")
    files.write_model_table(t, path)
    return files.read_model_table(spark, path, known_only="label")


@job("page_link_discovery", """
SELECT DISTINCT link FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages)
WHERE starts_with(link, '/') AND ends_with(link, 'e') UNION SELECT unnest(['/manual/a', '/manual/b'])""")
def page_link_discovery(spark, sf):
    return pages.discover_links(table(spark, sf, "pages"), "html", "/", "e", ["/manual/a", "/manual/b"])


@job("page_block_rows", """
SELECT page_id, CAST(n - 1 AS INTEGER) AS row_no, regexp_extract(b, 'href="([^"]*)"', 1) AS cell_0, regexp_extract(b, '>([^<]*)<', 1) AS cell_1 FROM (
  SELECT page_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS n FROM (
    SELECT page_id, regexp_extract_all(regexp_replace(html, '<!--|-->', '', 'g'), '(?s)<li[^>]*>(.*?)</li>', 1) AS bs FROM pages))
WHERE NOT regexp_matches(b, '>(The|the)<')""")
def page_block_rows(spark, sf):
    return pages.block_rows(table(spark, sf, "pages"), ["page_id"], "html", "li", ['href="([^"]*)"', ">([^<]*)<"], skip=">(The|the)<")


@job("header_dedupe", sql("""
SELECT entity, season, name, CASE WHEN rep = 0 THEN name WHEN no = 1 THEN concat(name, ' Offense') WHEN no = 2 THEN concat(name, ' Defense') ELSE concat(name, '_', no - 1) END AS unique_name
FROM (SELECT *, CAST(sum(rep) OVER (PARTITION BY entity ORDER BY season) AS BIGINT) AS no FROM (
  SELECT entity, season, last_priority AS name, CAST(row_number() OVER (PARTITION BY entity, last_priority ORDER BY season) > 1 AS INTEGER) AS rep FROM seasons))""", "seasons"))
def header_dedupe(spark, sf):
    headers = seasons(spark, sf).select("entity", "season", F.col("last_priority").alias("name"))
    return pages.dedupe_headers(headers, ["entity"], "season", "name", ["Offense", "Defense"])


@job("fill_forward_header", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS header_turn FROM conversations""")
def fill_forward_header(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    out = pages.fill_forward(c, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "header_turn")
    return out.select("conv_id", "turn", "header_turn")


GAP = 6 * 3600 * 1_000_000


@job("session_stints", f"""
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM (
  SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS stint FROM (
    SELECT user_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= {GAP} THEN 0 ELSE 1 END AS new
    FROM (SELECT user_id, epoch_us(ts) AS us FROM events))) GROUP BY user_id, stint""")
def session_stints(spark, sf):
    return ev.session_stints(table(spark, sf, "events"), "user_id", "ts", GAP)


@job("session_stints_stream", f"""
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM (
  SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS stint FROM (
    SELECT user_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= {GAP} THEN 0 ELSE 1 END AS new
    FROM (SELECT user_id, epoch_us(ts) AS us FROM events))) GROUP BY user_id, stint
HAVING max(us) + {GAP} <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events)""")
def session_stints_stream(spark, sf):
    """The stints that the watermark, one hour behind the latest event, has passed."""
    stream = ev.session_stream(ev.read_stream(spark, sf, "events.parquet"), "user_id", "ts", GAP, "1 hour")
    return ev.run_available(stream, partial_merge=True)


@job("stream_counts_by_period", f"""
SELECT event_type, start_us, start_us + 21600000000 AS end_us, count(*) AS n, {rnd('sum(value)', 4)} AS total FROM (
  SELECT event_type, value, epoch_us(ts) // 21600000000 * 21600000000 AS start_us FROM events)
WHERE start_us + 21600000000 <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events) GROUP BY 1, 2""")
def stream_counts_by_period(spark, sf):
    stream = ev.counts_stream(ev.read_stream(spark, sf, "events.parquet"), "event_type", "ts", "value", "6 hours", "1 hour")
    return ev.run_available(stream).withColumn("total", rounded(F.col("total"), 4))
