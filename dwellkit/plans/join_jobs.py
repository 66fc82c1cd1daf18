"""Jobs on lookups and point-in-time joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellkit.functions.hashing import hash_int
from dwellkit.functions.numeric import ratio_with_ties, rounded
from dwellkit.operators import lookups as lk
from dwellkit.operators import pit
from dwellkit.plans.base import history, rnd, seasons, sql, stints, table, targets
from dwellkit.plans.registry import job
from dwellkit.session import materialized
from dwellkit.plans.units import SIDES_SQL, UNITS_SQL, unit_seasons, unit_sides

HASH10 = "('0x' || substr(md5(concat_ws(':', '7', CAST(entity AS VARCHAR))), 1, 8))::BIGINT % 10"


@job("left_lookup_default", sql("""
SELECT entity, start_season, coalesce(segment, 'Unknown') AS segment FROM stints
LEFT JOIN (SELECT c_custkey, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0) ON c_custkey = entity""", "stints"))
def left_lookup_default(spark, sf):
    dim = (table(spark, sf, "customer").filter("c_acctbal > 0")
           .select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment")))
    return (lk.lookup_default(stints(spark, sf), dim, ["entity"], "segment", "Unknown")
            .select("entity", "start_season", "segment"))


@job("override_merge", sql(f"""
SELECT t.entity, end_season, coalesce(v.label, t.auto) AS resolved_label,
  CASE WHEN v.label IS NULL THEN 'deterministic' ELSE 'research' END AS label_source,
  (t.cause = 2 AND v.label IS NULL) AS gap
FROM (SELECT *, CASE cause WHEN 1 THEN 'event' ELSE 'censor' END AS auto FROM targets) t
LEFT JOIN (SELECT entity, end_season, CASE WHEN h < 5 THEN 'event' ELSE 'censor' END AS label
  FROM (SELECT *, {HASH10} AS h FROM targets) WHERE h IN (0, 3, 6, 9) AND cause = 2) v USING (entity, end_season)""", "targets"))
def override_merge(spark, sf):
    t = materialized(targets(spark, sf)).withColumn(
        "auto", F.when(F.col("cause") == 1, "event").otherwise("censor"))
    h = hash_int(7, F.col("entity")) % 10
    verdicts = (t.filter((F.col("cause") == 2) & h.isin(0, 3, 6, 9))
                .select("entity", "end_season", F.when(h < 5, "event").otherwise("censor").alias("auto")))
    out = lk.override_merge(t, verdicts, ["entity", "end_season"], "auto", F.col("cause") == 2)
    return out.select("entity", "end_season", "resolved_label", "label_source", "gap")


@job("range_dim_lookup", sql("""
SELECT u.unit, u.season, n_name AS alias, coalesce(r.key, f.key, lower(n_name)) AS key
FROM units u JOIN supplier ON s_suppkey = u.unit JOIN nation n ON n_nationkey = s_nationkey
LEFT JOIN (SELECT n_name AS alias, 0 AS lo, 1997 AS hi, r_name AS key FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey < 3
  UNION ALL SELECT n_name, 1998, 9999, r_name FROM nation JOIN region ON r_regionkey = (n_regionkey + 1) % 5 WHERE n_regionkey < 3) r
  ON r.alias = n.n_name AND u.season BETWEEN r.lo AND r.hi
LEFT JOIN (SELECT n_name AS alias, concat('flat-', n_nationkey) AS key FROM nation WHERE n_regionkey = 3) f ON f.alias = n.n_name""",
    units=UNITS_SQL))
def range_dim_lookup(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    named = nation.filter("n_regionkey < 3")
    early = named.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("n_name").alias("alias"), F.lit(0).alias("valid_from"), F.lit(1997).alias("valid_to"),
        F.col("r_name").alias("key"))
    late = named.join(region, F.col("r_regionkey") == (F.col("n_regionkey") + 1) % 5).select(
        F.col("n_name").alias("alias"), F.lit(1998).alias("valid_from"), F.lit(9999).alias("valid_to"),
        F.col("r_name").alias("key"))
    flat = nation.filter("n_regionkey = 3").select(
        F.col("n_name").alias("alias"), F.concat(F.lit("flat-"), "n_nationkey").alias("key"))
    names = (table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
             .select(F.col("s_suppkey").alias("unit"), F.col("n_name").alias("alias")))
    rows = unit_seasons(spark, sf).select("unit", "season").join(names, "unit")
    return lk.valid_lookup(rows, early.unionByName(late), flat, "alias", "season")


@job("candidate_first_match", sql("""
SELECT u.unit, u.season, arg_min(c.n_nationkey, c.pos) FILTER (e.season IS NOT NULL) AS found_key,
  CAST(min(c.pos) FILTER (e.season IS NOT NULL) AS INTEGER) AS found_pos
FROM units u JOIN supplier ON s_suppkey = u.unit
JOIN (SELECT a.n_nationkey AS own, b.n_nationkey,
    row_number() OVER (PARTITION BY a.n_nationkey ORDER BY a.n_nationkey <> b.n_nationkey, b.n_nationkey) - 1 AS pos
  FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey) c ON c.own = s_nationkey
LEFT JOIN existing e ON e.n_nationkey = c.n_nationkey AND e.season = u.season
GROUP BY 1, 2""", units=UNITS_SQL, existing="""SELECT s_nationkey AS n_nationkey, season FROM units
  JOIN supplier ON s_suppkey = unit GROUP BY 1, 2 HAVING 3 * sum(n_returned) > sum(n_lines)"""))
def candidate_first_match(spark, sf):
    nation, units = table(spark, sf, "nation"), materialized(unit_seasons(spark, sf))
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit"), "s_nationkey")
    # Own nation first, then the nations of its region by key.
    others = nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_set("n_nationkey")).alias("all"))
    lists = nation.join(others, "n_regionkey").select(
        F.col("n_nationkey").alias("s_nationkey"),
        F.concat(F.array("n_nationkey"), F.array_remove("all", F.col("n_nationkey"))).alias("candidates"))
    rows = units.select("unit", "season").join(supplier, "unit").join(lists, "s_nationkey").drop("s_nationkey")
    existing = (units.join(supplier, "unit").groupBy(F.col("s_nationkey").alias("n_nationkey"), "season")
                .agg((3 * F.sum("n_returned") > F.sum("n_lines")).alias("ok")).filter("ok"))
    return lk.first_candidate(rows, ["unit"], "candidates", existing, "season", "n_nationkey")


@job("canon_key_fallback", """
SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN concat('top:', coalesce(
    CASE WHEN p_name = 'small ring' THEN 'sr' WHEN p_name = 'red widget' THEN 'rw' END,
    CASE WHEN split_part(p_name, ' ', 2) = 'ring' THEN 'band' ELSE split_part(p_name, ' ', 2) END))
  ELSE concat('oth:', p_name) END AS canon FROM part""")
def canon_key_fallback(spark, sf):
    part = table(spark, sf, "part")
    mapped = F.when(F.col("p_name") == "small ring", "sr").when(F.col("p_name") == "red widget", "rw")
    return part.select("p_partkey", lk.canonical_key(
        F.col("p_name"), mapped, F.col("p_type").isin("ECONOMY", "STANDARD"), {"ring": "band"}).alias("canon"))


@job("learned_mapping", """
SELECT brand, code, CAST(n AS BIGINT) AS support FROM (
  SELECT p_brand AS brand, l_returnflag AS code, count(*) AS n,
    row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, l_returnflag) AS rn
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) WHERE rn = 1""")
def learned_mapping(spark, sf):
    # Counted per part before the join, so a part sold everywhere is a few rows.
    per_part = table(spark, sf, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("code")).agg(
        F.count(F.lit(1)).alias("n"))
    brand = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    pairs = per_part.join(brand, F.col("l_partkey") == F.col("p_partkey"))
    return lk.learned_mapping(pairs, "brand", "code", "n")


@job("lag_year_lookup", sql(f"""
SELECT a.unit, a.season, {rnd('b.price', 2)} AS prev_price, b.n_lines AS prev_n_lines
FROM units a LEFT JOIN units b ON a.unit = b.unit AND b.season = a.season - 1""", units=UNITS_SQL))
def lag_year_lookup(spark, sf):
    u = unit_seasons(spark, sf)
    out = pit.lag_season(u.select("unit", "season"), u, ["unit"], "season", ["price", "n_lines"])
    return out.withColumn("prev_price", rounded(F.col("prev_price"), 2))


@job("lookback_context", sql(f"""
SELECT u.unit, u.season, {rnd('avg(p.price - coalesce(p.price_opp, 0))', 4)} AS own_price,
  {rnd('avg(p.price_opp)', 4)} AS opp_price, {rnd('avg((p.n_lines - p.n_returned) / p.n_lines)')} AS keep_ratio,
  count(p.unit) FILTER (3 * p.n_returned > p.n_lines) AS n_heavy
FROM units u LEFT JOIN units p ON p.unit = u.unit AND p.season IN (u.season - 1, u.season - 2)
GROUP BY 1, 2""", units=UNITS_SQL))
def lookback_context(spark, sf):
    u = unit_seasons(spark, sf)
    out = pit.lookback_mean(
        u.select("unit", F.col("season").alias("anchor")), u, ["unit"], "anchor", "season",
        {"own_price": F.col("price") - F.coalesce("price_opp", F.lit(0.0)), "opp_price": F.col("price_opp"),
         "keep_ratio": (F.col("n_lines") - F.col("n_returned")) / F.col("n_lines")},
        counts={"n_heavy": 3 * F.col("n_returned") > F.col("n_lines")})
    return out.select("unit", F.col("anchor").alias("season"), rounded(F.col("own_price"), 4).alias("own_price"),
                      rounded(F.col("opp_price"), 4).alias("opp_price"),
                      rounded(F.col("keep_ratio")).alias("keep_ratio"), "n_heavy")


@job("pit_features_join", sql(f"""
SELECT s.entity, s.start_season, CAST(coalesce(sum(q.n_rows), 0) AS BIGINT) AS prior_orders,
  CAST(coalesce(sum(q.w), 0) AS BIGINT) AS prior_wins, {rnd('coalesce(sum(q.spend), 0)', 2)} AS prior_spend,
  count(q.entity) AS prior_seasons
FROM stints s LEFT JOIN seasons q ON q.entity = s.entity AND q.season < s.start_season GROUP BY 1, 2""", "stints"))
def pit_features_join(spark, sf):
    out = pit.pit_features(
        stints(spark, sf).select("entity", "start_season"), seasons(spark, sf), ["entity"], "start_season", "season",
        {"prior_orders": F.col("n_rows"), "prior_wins": F.col("w"), "prior_spend": F.col("spend"),
         "prior_seasons": F.lit(1)})
    return out.withColumn("prior_spend", rounded(F.col("prior_spend"), 2))


@job("asof_last_state", sql("""
SELECT s.entity, s.start_season, q.last_status, q.last_priority
FROM stints s ASOF LEFT JOIN seasons q ON s.entity = q.entity AND s.start_season > q.season""", "stints"))
def asof_last_state(spark, sf):
    return pit.asof_before(stints(spark, sf).select("entity", "start_season"), seasons(spark, sf), ["entity"],
                           "start_season", "season", ["last_status", "last_priority"], prefix="")


@job("interval_contains", sql("""
SELECT p.entity, p.season, p.n_rows, s.start_season, s.end_season, s.entity IS NOT NULL AS matched
FROM (SELECT entity, season + 2 AS season, n_rows FROM seasons) p LEFT JOIN stints s
  ON s.entity = p.entity AND p.season BETWEEN s.start_season AND s.end_season""", "stints"))
def interval_contains(spark, sf):
    points = seasons(spark, sf).select("entity", (F.col("season") + 2).alias("season"), "n_rows")
    return pit.interval_contains(points, stints(spark, sf), ["entity"], "season")


@job("stint_spans_points", sql("""
SELECT s.entity, s.stint_no, count(p.season) AS n_points, min(p.season) AS first_point
FROM stints s LEFT JOIN (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS season, month(l_shipdate) AS m
  FROM lineitem) p
  ON p.season BETWEEN s.start_season AND s.end_season GROUP BY 1, 2""", "stints"))
def stint_spans_points(spark, sf):
    li = table(spark, sf, "lineitem")
    points = li.select(F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("m")).distinct()
    out = pit.spans_of_points(stints(spark, sf), points, "season", ["entity", "stint_no"])
    return out.select("entity", "stint_no", "n_points", "first_point")


@job("membership_prior", sql("""
SELECT q.entity, q.season, q.last_priority AS priority, CAST(p.entity IS NOT NULL AS INTEGER) AS was_member
FROM seasons q LEFT JOIN (SELECT DISTINCT entity, priority, season + 1 AS season FROM history) p
  ON p.entity = q.entity AND p.priority = q.last_priority AND p.season = q.season""", "seasons"))
def membership_prior(spark, sf):
    anchors = seasons(spark, sf).select("entity", "season", F.col("last_priority").alias("priority"))
    return pit.member_before(anchors, history(spark, sf).select("entity", "priority", F.col("season").alias("y")),
                             ["entity", "priority"], "season", "y")


@job("exact_then_substring", """
WITH dim AS (SELECT p_name AS dn, count(*) AS info FROM part WHERE p_name LIKE 's%' OR p_name LIKE 'r%' GROUP BY 1),
names AS (SELECT DISTINCT p_name FROM part),
near AS (SELECT p_name, min(dn) AS found FROM names JOIN dim ON contains(lower(dn), lower(split_part(p_name, ' ', 2)))
  WHERE p_name NOT IN (SELECT dn FROM dim) GROUP BY 1)
SELECT p_partkey, p.p_name, CASE WHEN e.dn IS NOT NULL THEN 'exact' WHEN near.found IS NOT NULL THEN 'token' ELSE 'none' END AS match_kind,
  coalesce(e.info, t.info, 0) AS info
FROM part p LEFT JOIN dim e ON e.dn = p.p_name LEFT JOIN near ON near.p_name = p.p_name LEFT JOIN dim t ON t.dn = near.found""")
def exact_then_substring(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    dim = (part.filter("p_name LIKE 's%' OR p_name LIKE 'r%'").groupBy(F.col("p_name").alias("dn"))
           .agg(F.count(F.lit(1)).alias("info")))
    return lk.exact_then_substring(part, "p_name", dim, "dn", {"info": 0})


@job("shared_unit_primary", sql("""
SELECT u.unit, u.season, m.is_primary FROM units u LEFT JOIN (
  SELECT season, member, bool_or(member = primary_name) AS is_primary FROM (
    SELECT season, primary_name, unnest(string_split(names, '/')) AS member FROM (
      SELECT season, s_nationkey, max(s_name) AS primary_name, concat(max(s_name), '/', min(s_name)) AS names
      FROM units JOIN supplier ON s_suppkey = unit GROUP BY 1, 2)) GROUP BY 1, 2) m
ON m.season = u.season AND m.member = (SELECT s_name FROM supplier WHERE s_suppkey = u.unit)""", units=UNITS_SQL))
def shared_unit_primary(spark, sf):
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit"), "s_nationkey",
                                                   F.col("s_name").alias("member"))
    rows = unit_seasons(spark, sf).select("unit", "season").join(supplier, "unit")
    shared = rows.groupBy("season", "s_nationkey").agg(
        F.max("member").alias("primary_name"), F.concat_ws("/", F.max("member"), F.min("member")).alias("names"))
    members = lk.shared_members(shared, "names", "primary_name", ["season"])
    return rows.join(members, ["season", "member"], "left").select("unit", "season", "is_primary")


@job("scheme_cross", sql("""
SELECT scheme, scheme_class, count(*) AS n FROM (
  SELECT s.scheme, CASE WHEN duration <= lo THEN 0 WHEN duration <= hi THEN 1 ELSE 2 END AS scheme_class
  FROM targets, (VALUES ('1/2-3/4+', 1, 3), ('2/3-4/5+', 2, 4), ('3/4-5/6+', 3, 5)) s(scheme, lo, hi)) GROUP BY 1, 2""", "targets"))
def scheme_cross(spark, sf):
    schemes = {"1/2-3/4+": (1, 3), "2/3-4/5+": (2, 4), "3/4-5/6+": (3, 5)}
    return (lk.with_schemes(targets(spark, sf), schemes, "duration")
            .groupBy("scheme", "scheme_class").agg(F.count(F.lit(1)).alias("n")))


@job("anti_exclusions", sql("""
SELECT entity, start_season, CASE WHEN entity IN (SELECT entity FROM targets WHERE cause = 0) THEN 'seen' ELSE 'new' END AS pool
FROM targets WHERE cause <> 0 AND (entity, start_season) NOT IN
  (SELECT entity, min(start_season) FROM targets WHERE cause = 2 GROUP BY entity)""", "targets"))
def anti_exclusions(spark, sf):
    t = materialized(targets(spark, sf))
    listed = t.filter("cause = 2").groupBy("entity").agg(F.min("start_season").alias("start_season"))
    rows = lk.without(t.filter("cause <> 0"), listed, ["entity", "start_season"])
    active = t.filter("cause = 0").select("entity").distinct()
    new = lk.without(rows, active, ["entity"]).withColumn("pool", F.lit("new"))
    seen = rows.join(active, "entity", "left_semi").withColumn("pool", F.lit("seen"))
    return new.unionByName(seen).select("entity", "start_season", "pool")
