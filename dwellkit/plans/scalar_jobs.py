"""Jobs on projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellkit.functions import numeric as nm
from dwellkit.functions import text as tx
from dwellkit.functions.numeric import rounded
from dwellkit.operators.running import running
from dwellkit.operators.survival import argmax
from dwellkit.plans.base import history, rnd, seasons, sql, stints, table
from dwellkit.plans.registry import job
from dwellkit.plans.units import SIDES_SQL, unit_sides

# Role texts that exercise every branch of the rules; an order picks one by its key.
ROLES = ["Head Coach", "Interim Head Coach", "Assistant Head Coach/Linebackers", "Offensive Coordinator",
         "Interim Offensive Coordinator", "Defensive Coordinator/Linebackers", "Interim Defensive Coordinator",
         "Special Teams Coordinator", "Interim Special Teams Coordinator", "Run Game Coordinator",
         "Passing Game Coordinator", "Assistant", "Asst. Coach", "Asst./Quarterbacks", "Quarterbacks",
         "Defensive Quality Control", "Linebackers", "Associate Head Coach", "Freshman Coach", "", "Secondary",
         "Tight Ends/Defensive Line", "Scout"]
LEVELS = ["NFL", "NFL Europe", "College", "College (NFL Academy)", "USFL", ""]


def _pick(items, by):
    return F.element_at(F.array(*[F.lit(x) for x in items]), (by % len(items) + 1).cast("int"))


def _pick_sql(items, by):
    return "[" + ", ".join("'" + x + "'" for x in items) + f"][CAST({by} % {len(items)} + 1 AS INTEGER)]"


ROLE_SQL = _pick_sql(ROLES, "o_orderkey")
ROLE_ROWS = f"SELECT o_orderkey, o_custkey, {ROLE_SQL} AS role, {_pick_sql(LEVELS, 'o_orderkey')} AS lvl FROM orders"


def role_rows(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_custkey", _pick(ROLES, F.col("o_orderkey")).alias("role"),
                    _pick(LEVELS, F.col("o_orderkey")).alias("lvl"))


def _any_sql(col, words, fn="contains"):
    return "(" + " OR ".join(f"{fn}({col}, '{w}')" for w in words) + ")"


@job("coerce_numeric", """
SELECT l_orderkey, l_linenumber, v, TRY_CAST(trim(v) AS DOUBLE) + 0.0 AS num FROM (
  SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN ''
    WHEN 3 THEN concat(' ', CAST(l_orderkey AS VARCHAR), ' ') WHEN 4 THEN '.364' WHEN 5 THEN '-1.5' ELSE '1.2.3' END AS v
  FROM lineitem) WHERE v IS NOT NULL""")
def coerce_numeric(spark, sf):
    m = F.col("l_linenumber") % 7
    text = (F.when(m == 1, "n/a").when(m == 2, "").when(m == 3, F.concat(F.lit(" "), "l_orderkey", F.lit(" ")))
            .when(m == 4, ".364").when(m == 5, "-1.5").when(m == 6, "1.2.3"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("v")).dropna(subset=["v"])
    return li.withColumn("num", nm.to_number(F.col("v")) + F.lit(0.0))


@job("parse_stat_strings", f"""
SELECT l_orderkey, l_linenumber, {rnd("CAST(rtrim(pct, '%') AS DOUBLE) / 100")} AS share,
  {rnd("CAST(split_part(clock, ':', 1) AS DOUBLE) + CAST(split_part(clock, ':', 2) AS DOUBLE) / 60")} AS minutes,
  {rnd("CAST(split_part(place, ' ', 2) AS DOUBLE)")} AS yards
FROM (SELECT l_orderkey, l_linenumber, concat(CAST(round(l_discount * 100) AS INTEGER), '.', l_linenumber, '%') AS pct,
  concat(l_linenumber, ':', CAST(l_quantity AS INTEGER)) AS clock,
  concat('Own ', CAST(l_quantity AS INTEGER), '.', l_linenumber) AS place FROM lineitem)""")
def parse_stat_strings(spark, sf):
    qty = F.col("l_quantity").cast("int")
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.concat(F.round(F.col("l_discount") * 100).cast("int"), F.lit("."), "l_linenumber", F.lit("%")).alias("pct"),
        F.concat("l_linenumber", F.lit(":"), qty).alias("clock"),
        F.concat(F.lit("Own "), qty, F.lit("."), "l_linenumber").alias("place"))
    return li.select("l_orderkey", "l_linenumber", rounded(tx.parse_percent(F.col("pct"))).alias("share"),
                     rounded(tx.parse_clock(F.col("clock"))).alias("minutes"),
                     rounded(tx.parse_last_number(F.col("place"))).alias("yards"))


@job("classify_role", f"""
SELECT o_orderkey, role, CASE WHEN role = '' OR {_any_sql('role', tx.EXCLUDED_ROLE_WORDS)} THEN 'NONE'
  WHEN (contains(role, 'Assistant') OR contains(role, 'Asst')) AND NOT contains(role, '/') THEN 'NONE'
  WHEN contains(role, 'Head Coach') AND NOT contains(role, 'Ass') AND NOT contains(role, 'Interim') THEN 'HC'
  WHEN contains(role, 'Coordinator') THEN CASE
    WHEN contains(role, 'Offensive Coordinator') AND NOT contains(role, 'Interim O') THEN 'OC'
    WHEN contains(role, 'Defensive Coordinator') AND NOT contains(role, 'Interim D') THEN 'DC'
    WHEN contains(role, 'Special') AND NOT contains(role, 'Interim S') THEN 'STC' ELSE 'POS' END
  ELSE 'POS' END AS role_class FROM ({ROLE_ROWS})""")
def classify_role(spark, sf):
    return role_rows(spark, sf).select("o_orderkey", "role", tx.classify_role(F.col("role")).alias("role_class"))


@job("classify_level", f"""
SELECT lvl, CASE WHEN contains(lvl, 'College') THEN 'College' WHEN contains(lvl, 'NFL') AND lvl <> 'NFL Europe' THEN 'NFL'
  ELSE 'None' END AS level_class, contains(lvl, 'NFL') AND lvl <> 'NFL Europe' AS top_level, count(*) AS n
FROM ({ROLE_ROWS}) GROUP BY 1, 2, 3""")
def classify_level(spark, sf):
    return (role_rows(spark, sf).groupBy("lvl", tx.classify_level(F.col("lvl")).alias("level_class"),
                                         tx.is_top_level(F.col("lvl")).alias("top_level"))
            .agg(F.count(F.lit(1)).alias("n")))


@job("classify_side", f"""
SELECT role, CASE WHEN o AND NOT d THEN 'off' WHEN d AND NOT o THEN 'def' ELSE 'other' END AS side, count(*) AS n
FROM (SELECT role, {_any_sql('lower(role)', tx.OFFENSE_WORDS)} AS o, {_any_sql('lower(role)', tx.DEFENSE_WORDS)} AS d
  FROM ({ROLE_ROWS})) GROUP BY 1, 2""")
def classify_side(spark, sf):
    return (role_rows(spark, sf).groupBy("role", tx.classify_side(F.col("role")).alias("side"))
            .agg(F.count(F.lit(1)).alias("n")))


@job("pattern_background", f"""
SELECT entity, a AS first_count, b AS second_count, CASE WHEN a > 2 AND b > 2 THEN 'Both' WHEN a > b THEN 'Offensive'
  WHEN b > a THEN 'Defensive' WHEN a > 0 THEN 'Offensive' ELSE 'Other' END AS background
FROM (SELECT o_custkey AS entity,
  count(*) FILTER (NOT contains(lower(role), 'head coach') AND regexp_matches(role, '{"|".join(tx.OFFENSE_PATTERNS)}', 'i')) AS a,
  count(*) FILTER (NOT contains(lower(role), 'head coach') AND regexp_matches(role, '{"|".join(tx.DEFENSE_PATTERNS)}', 'i')) AS b
  FROM ({ROLE_ROWS}) GROUP BY 1)""")
def pattern_background(spark, sf):
    role = F.col("role")
    other = ~F.lower(role).contains("head coach")
    # The patterns run once per (entity, role text), not once per record.
    texts = role_rows(spark, sf).groupBy(F.col("o_custkey").alias("entity"), "role").agg(F.count(F.lit(1)).alias("n"))
    counts = texts.groupBy("entity").agg(
        F.sum(F.when(other & tx.pattern_match(role, tx.OFFENSE_PATTERNS), F.col("n")).otherwise(0)).alias("first_count"),
        F.sum(F.when(other & tx.pattern_match(role, tx.DEFENSE_PATTERNS), F.col("n")).otherwise(0)).alias("second_count"))
    return counts.withColumn("background", tx.background_of(F.col("first_count"), F.col("second_count")))


KEYWORDS = {"note_forced": tx.FORCED_WORDS + ["tion"], "note_resigned": tx.RESIGNED_WORDS,
            "note_voluntary": tx.VOLUNTARY_WORDS + ["sch"]}


@job("keyword_flags", "SELECT doc_id, " + ", ".join(
    f"{_any_sql('lower(text)', ws)} AS {k}" for k, ws in KEYWORDS.items()) + " FROM documents")
def keyword_flags(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", *[tx.keyword_flag(F.col("text"), ws).alias(k) for k, ws in KEYWORDS.items()])


@job("bin_ordinal", sql("""
SELECT entity, start_season, CASE WHEN d IS NULL THEN -1 WHEN d <= 2 THEN 0 WHEN d <= 4 THEN 1 ELSE 2 END AS base_class,
  CASE WHEN d IS NULL THEN -1 WHEN d <= 1 THEN 0 WHEN d <= 3 THEN 1 ELSE 2 END AS low_class,
  CASE WHEN d IS NULL THEN -1 WHEN d <= 1.5 THEN 0 WHEN d <= 2.5 THEN 1 WHEN d <= 5.5 THEN 2 ELSE 3 END AS fine_class
FROM (SELECT entity, start_season, nullif(duration, 6) AS d FROM stints)""", "stints"))
def bin_ordinal(spark, sf):
    d = F.nullif(F.col("duration"), F.lit(6))
    return stints(spark, sf).select(
        "entity", "start_season", nm.bin_right_closed(d, [2, 4]).alias("base_class"),
        nm.bin_right_closed(d, [1, 3]).alias("low_class"),
        nm.bin_right_closed(d, [1.5, 2.5, 5.5]).alias("fine_class"))


@job("ratio_with_ties", sql(f"""
SELECT entity, season, {rnd('(w + 0.5 * t) / (w + l + t)')} AS ratio,
  {rnd('CASE WHEN w + l > 0 THEN w / (w + l) ELSE t / 10.0 END')} AS decisive_ratio,
  {rnd('CASE WHEN w + l > 0 THEN w / (w + l) ELSE 0 END')} AS decisive_or_zero FROM seasons""", "seasons"))
def ratio_with_ties(spark, sf):
    w, lost, t, none = F.col("w"), F.col("l"), F.col("t"), F.lit(0)
    return seasons(spark, sf).select(
        "entity", "season", rounded(nm.ratio_with_ties(w, lost, t)).alias("ratio"),
        rounded(nm.ratio_with_ties(w, lost, none, recorded=t / 10.0)).alias("decisive_ratio"),
        rounded(nm.ratio_with_ties(w, lost, none, when_empty=0)).alias("decisive_or_zero"))


@job("rank_to_percentile", sql(f"""
SELECT unit, season, CAST(rank() OVER (PARTITION BY season ORDER BY price DESC) AS BIGINT) AS rank_no,
  {rnd('CASE WHEN count(*) OVER (PARTITION BY season) > 1 THEN 1.0 - (rank() OVER (PARTITION BY season ORDER BY price DESC) - 1.0) / (count(*) OVER (PARTITION BY season) - 1.0) END')} AS percentile
FROM units""", units="""SELECT l_suppkey AS unit, CAST(year(l_shipdate) AS INTEGER) AS season,
  CAST(round(sum(TRY_CAST(l_extendedprice AS DECIMAL(18, 2)))) AS DOUBLE) AS price FROM lineitem GROUP BY 1, 2"""))
def rank_to_percentile(spark, sf):
    # Whole units of exact sums of cents: sums of doubles depend on their order, and half units would go either way.
    u = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), F.year("l_shipdate").alias("season")).agg(
        F.round(F.sum(F.col("l_extendedprice").try_cast("decimal(18, 2)"))).cast("double").alias("price"))
    # A unit without any price comes last.
    u = u.withColumn("price", F.coalesce("price", F.lit(-1.7976931348623157e308)))
    # A season may hold very many units: rank its distinct values by running counts.
    values = u.groupBy("season", "price").agg(F.count(F.lit(1)).alias("n"))
    r = running(values, "price", {"c": F.col("n")}, ["season"])
    rank = (F.col("c_total") - F.col("c_before") - F.col("n") + 1).cast("bigint")
    ranks = r.select("season", "price", rank.alias("rank_no"), F.col("c_total").alias("size"))
    return (u.join(ranks, ["season", "price"])
            .select("unit", "season", "rank_no", rounded(
                nm.rank_to_percentile(F.col("rank_no"), F.col("size"))).alias("percentile")))


@job("orient_sign", sql(f"""
SELECT unit, season, side, {rnd("CASE side WHEN 'own' THEN price ELSE -price END", 2)} AS price,
  {rnd("CASE side WHEN 'own' THEN -discount ELSE discount END", 12)} AS "Int discount" FROM sides""", sides=SIDES_SQL))
def orient_sign(spark, sf):
    side = F.when(F.col("side") == "own", 1.0).otherwise(-1.0)
    named = unit_sides(spark, sf).withColumnRenamed("discount", "Int discount")
    return named.select("unit", "season", "side", *[
        rounded(F.col(c) * nm.measure_sign(c) * side, d).alias(c) for c, d in (("price", 2), ("Int discount", 12))])


@job("role_selected_column", f"""
SELECT o_orderkey, CASE WHEN contains(upper(role_class), 'OC') THEN o_totalprice WHEN contains(upper(role_class), 'DC') THEN -o_totalprice
  ELSE o_totalprice / 2 END AS unit_value
FROM (SELECT o_orderkey, o_totalprice, ['OC', 'DC', 'HC', 'POS'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS role_class FROM orders)""")
def role_selected_column(spark, sf):
    o = table(spark, sf, "orders")
    price, role = F.col("o_totalprice"), _pick(["OC", "DC", "HC", "POS"], F.col("o_orderkey"))
    return o.select("o_orderkey", tx.unit_column(role, price, -price, price / 2).alias("unit_value"))


POSITIONAL = ["unit_price", "unit_quantity", "ctx_discount", "ctx_tax"]
REDUNDANT = ["unit_quantity", "not_there"]


@job("positional_names", """SELECT l_orderkey, l_linenumber, l_extendedprice AS unit_price, l_discount AS ctx_discount,
  l_tax AS ctx_tax FROM lineitem""")
def positional_names(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("Feature 1"), F.col("l_quantity").alias("Feature 2"),
        F.col("l_discount").alias("Feature 3"), F.col("l_tax").alias("Feature 4"))
    named = raw.withColumnsRenamed({f"Feature {i}": n for i, n in enumerate(POSITIONAL, 1)}).drop(*REDUNDANT)
    families = [c for c in named.columns if c.startswith(("unit_", "ctx_"))]
    return named.select("l_orderkey", "l_linenumber", *families)


@job("format_record", sql("""
SELECT q.entity, q.season, concat(w, '-', l, CASE WHEN t > 0 THEN concat('-', t) ELSE '' END) AS record,
  array_to_string(list_slice(p.ps, 1, 3), ', ') AS sample
FROM seasons q JOIN (SELECT entity, season, list_sort(list(DISTINCT priority)) AS ps FROM history GROUP BY 1, 2) p
USING (entity, season)""", "seasons"))
def format_record(spark, sf):
    # The set holds at most the few distinct priorities, whatever the number of records.
    return history(spark, sf).groupBy("entity", "season").agg(
        tx.format_record(*[F.count_if(F.col("status") == s) for s in "FOP"]).alias("record"),
        F.array_join(F.slice(F.array_sort(F.collect_set("priority")), 1, 3), ", ").alias("sample"))


@job("decade_bucket", """
SELECT o_orderkey, concat(CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER), 's') AS decade,
  CASE WHEN year(o_orderdate) >= 2000 THEN '2000s+' ELSE concat(CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER), 's') END AS decade_open
FROM orders""")
def decade_bucket(spark, sf):
    y = F.year("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", nm.decade_label(y).alias("decade"),
                                             nm.decade_label(y, 2000).alias("decade_open"))


@job("confidence_band", f"""
SELECT l_orderkey, l_linenumber, {rnd('greatest(p0, p1, p2)')} AS top_p,
  CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS predicted,
  CASE WHEN greatest(p0, p1, p2) >= 0.7 THEN 'HIGH' WHEN greatest(p0, p1, p2) >= 0.5 THEN 'MED' ELSE 'LOW' END AS band
FROM (SELECT l_orderkey, l_linenumber, l_quantity / 100 AS p0, l_discount * 5 AS p1, 1 - l_quantity / 100 - l_discount * 5 AS p2 FROM lineitem)""")
def confidence_band(spark, sf):
    p = [F.col("l_quantity") / 100, F.col("l_discount") * 5, 1 - F.col("l_quantity") / 100 - F.col("l_discount") * 5]
    top = F.greatest(*p)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", rounded(top).alias("top_p"), argmax(p).alias("predicted"),
        F.when(top >= 0.7, "HIGH").when(top >= 0.5, "MED").otherwise("LOW").alias("band"))


@job("row_nanmean", f"""
SELECT l_orderkey, l_linenumber, {rnd('(SELECT avg(x) FROM (SELECT unnest([a, b, c]) AS x))')} AS mean_present,
  {rnd('coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)')} AS sum_zero,
  {rnd('CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN NULL ELSE coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) END')} AS sum_or_null
FROM (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.0) AS a, nullif(l_tax, 0.0) AS b,
  CASE WHEN l_quantity > 25 THEN l_quantity END AS c FROM lineitem)""")
def row_nanmean(spark, sf):
    cols = [F.nullif(F.col("l_discount"), F.lit(0.0)), F.nullif(F.col("l_tax"), F.lit(0.0)),
            F.when(F.col("l_quantity") > 25, F.col("l_quantity"))]
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", rounded(nm.row_mean(cols)).alias("mean_present"),
        rounded(nm.row_sum(cols)).alias("sum_zero"), rounded(nm.row_sum(cols, None)).alias("sum_or_null"))


@job("filter_population", """SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS season FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '2000-01-01' AND o_orderstatus <> 'P'""")
def filter_population(spark, sf):
    # Ranges on the stored date (not on year(date)) reach the file scan.
    return (table(spark, sf, "orders")
            .filter((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
                    & (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
                    & (F.col("o_orderstatus") != "P"))
            .select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("season")))
