"""Jobs on grouped splits, resampling and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellkit.functions.hashing import hash_int
from dwellkit.functions.dist import t_quantile
from dwellkit.functions.numeric import rounded, safe_div
from dwellkit.operators import hypothesis as hy
from dwellkit.operators import metrics as mt
from dwellkit.operators import resample as rs
from dwellkit.operators import splits as sp
from dwellkit.plans.base import history, rnd, seasons, sql, table, targets
from dwellkit.plans.registry import job
from dwellkit.plans.survival_jobs import two_sided
from dwellkit.session import materialized

#: Resamples of the metric and value bootstraps, and subsamples of the groups.
SEED, FRACTION, FOLDS, B, SUBSAMPLES = 42, 0.2, 5, 1000, 2000


def md5_of(*parts):
    return "md5(concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def int_of(*parts):
    return f"('0x' || substr({md5_of(*parts)}, 1, 8))::BIGINT"


def wide_of(*parts):
    return f"('0x' || substr({md5_of(*parts)}, 1, 15))::BIGINT"


MODES = """SELECT entity, label AS stratum, CAST(n_rows AS BIGINT) AS n_rows FROM (
  SELECT entity, label, sum(n) OVER (PARTITION BY entity) AS n_rows, row_number() OVER (PARTITION BY entity ORDER BY n DESC, label) AS rn
  FROM (SELECT entity, label, count(*) AS n FROM targets GROUP BY 1, 2)) WHERE rn = 1"""


@job("group_split_stratified", sql(f"""
SELECT entity, stratum, n_rows, CASE WHEN before < floor(q.n * {FRACTION}) THEN 'test' ELSE 'train' END AS side FROM (
  SELECT *, coalesce(sum(n_rows) OVER (PARTITION BY stratum ORDER BY {md5_of(f"'{SEED}'", 'entity')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM modes)
JOIN (SELECT label, count(*) AS n FROM targets GROUP BY 1) q ON q.label = stratum""", "targets", modes=MODES))
def group_split_stratified(spark, sf):
    return sp.split_stratified(materialized(targets(spark, sf)), "entity", "label", FRACTION, SEED)


@job("group_kfold_stratified", sql(f"""
SELECT entity, stratum, CAST(least(floor(i / greatest(1, floor(n / {FOLDS}))), {FOLDS - 1}) AS INTEGER) AS fold FROM (
  SELECT entity, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {md5_of(f"'{SEED}'", 'entity')}) - 1 AS i, count(*) OVER (PARTITION BY stratum) AS n FROM modes)""",
    "targets", modes=MODES))
def group_kfold_stratified(spark, sf):
    return sp.kfold(targets(spark, sf), "entity", FOLDS, SEED, "label")


ORDERED = f"""SELECT entity, row_number() OVER (ORDER BY {md5_of(f"'{SEED}'", 'entity')}) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT entity FROM targets)"""


@job("group_split_random", sql(f"SELECT entity, CASE WHEN i < floor(n * {FRACTION}) THEN 'test' ELSE 'train' END AS side FROM ordered", "targets", ordered=ORDERED))
def group_split_random(spark, sf):
    return sp.split_random(targets(spark, sf), "entity", FRACTION, SEED)


@job("group_kfold_random", sql(f"SELECT entity, CAST(least(floor(i / floor(n / {FOLDS})), {FOLDS - 1}) AS INTEGER) AS fold FROM ordered", "targets", ordered=ORDERED))
def group_kfold_random(spark, sf):
    return sp.kfold(targets(spark, sf), "entity", FOLDS, SEED)


@job("group_subsample", sql(f"""
SELECT b, entity FROM (SELECT CAST(b AS INTEGER) AS b, entity, row_number() OVER (PARTITION BY b ORDER BY {md5_of(f"'{SEED}'", 'b', 'entity')}) - 1 AS i, count(*) OVER (PARTITION BY b) AS n
  FROM (SELECT DISTINCT entity FROM targets), range({SUBSAMPLES}) r(b)) WHERE i < greatest(1, floor(n * 0.5))""", "targets"))
def group_subsample(spark, sf):
    return sp.subsample(targets(spark, sf), "entity", 0.5, SUBSAMPLES, SEED)


# Test set of the class metrics: the label of each stint, and two simple predictions of it.
SCORED = """SELECT label AS truth, CASE WHEN start_season <= 1996 THEN 2 WHEN start_season <= 1999 THEN 1 ELSE 0 END AS pred_a,
  CASE WHEN stint_no = 1 THEN 1 ELSE 0 END AS pred_b FROM targets"""
BLOCKS = """SELECT *, sum(c) OVER (ORDER BY truth, pred_a, pred_b) AS hi, sum(c) OVER (ORDER BY truth, pred_a, pred_b) - c AS lo, sum(c) OVER () AS total
  FROM (SELECT truth, pred_a, pred_b, count(*) AS c FROM scored GROUP BY ALL)"""
DRAWN = f"""SELECT d.b, k.truth, k.pred_a, k.pred_b, count(*) AS n FROM (
  SELECT b, {wide_of(f"'{SEED}'", 'b', 'i')} % (SELECT count(*) FROM scored) AS u FROM range({B}) r(b), range((SELECT count(*) FROM scored)) s(i)) d
  JOIN blocks k ON d.u >= k.lo AND d.u < k.hi GROUP BY ALL"""


def _stats(pred):
    return f"""SELECT b, sum(n * abs(truth - {pred})) / sum(n) AS mae, sum(n * CAST(truth = {pred} AS INTEGER)) / sum(n) AS exact_accuracy,
      1 - sum(n * (truth - {pred}) * (truth - {pred})) / ((sum(n) * (sum(n * truth * truth) + sum(n * {pred} * {pred})) - 2 * sum(n * truth) * sum(n * {pred})) / sum(n)) AS qwk
      FROM drawn GROUP BY b HAVING count(DISTINCT truth) = 3"""


def scored(spark, sf):
    y = F.col("start_season")
    return targets(spark, sf).select(
        F.col("label").alias("truth"), F.when(y <= 1996, 2).when(y <= 1999, 1).otherwise(0).alias("pred_a"),
        F.when(F.col("stint_no") == 1, 1).otherwise(0).alias("pred_b"))


METRICS = ["mae", "exact_accuracy", "qwk"]


def _drawn(spark, sf):
    return rs.bootstrap_cells(scored(spark, sf), ["truth", "pred_a", "pred_b"], B, SEED)


def _metrics(cells, pred):
    # A resample that misses a class is skipped.
    return mt.ordinal_summary(cells, "truth", pred, 3, n="n", by=["b"]).filter("n_classes = 3").select("b", *METRICS)


@job("bootstrap_ci", sql(" UNION ALL ".join(f"""SELECT '{m}' AS metric, {rnd(f'avg({m})')} AS mean, {rnd(f'stddev_pop({m})')} AS sd, {rnd(f'quantile_cont({m}, 0.025)')} AS ci_low,
  {rnd(f'quantile_cont({m}, 0.975)')} AS ci_high, count({m}) AS n_valid FROM stats""" for m in METRICS),
    "targets", scored=SCORED, blocks=BLOCKS, drawn=DRAWN, stats=_stats("pred_a")))
def bootstrap_ci(spark, sf):
    out = rs.percentile_ci(_metrics(_drawn(spark, sf), "pred_a"), METRICS)
    return out.select("metric", "n_valid", *[rounded(F.col(c)).alias(c) for c in ("mean", "sd", "ci_low", "ci_high")])


@job("bootstrap_paired", sql(" UNION ALL ".join(f"""SELECT '{m}' AS metric, {rnd(f'avg(a.{m} - c.{m})')} AS mean, {rnd(f'quantile_cont(a.{m} - c.{m}, 0.025)')} AS ci_low,
  {rnd(f'quantile_cont(a.{m} - c.{m}, 0.975)')} AS ci_high, {rnd(f'avg(CAST(a.{m} - c.{m} {">=" if m == "mae" else "<="} 0 AS INTEGER))')} AS p FROM sa a JOIN sb c USING (b)""" for m in METRICS),
    "targets", scored=SCORED, blocks=BLOCKS, drawn=DRAWN, sa=_stats("pred_a"), sb=_stats("pred_b")))
def bootstrap_paired(spark, sf):
    cells = materialized(_drawn(spark, sf))  # both models read the same draws
    other = _metrics(cells, "pred_b").withColumnsRenamed({m: f"o_{m}" for m in METRICS})
    both = _metrics(cells, "pred_a").join(other, "b").select("b", *[(F.col(m) - F.col(f"o_{m}")).alias(m) for m in METRICS])
    ci = rs.percentile_ci(both, METRICS)
    # One-sided share of resamples in which the first model is not better.
    share = both.agg(*[F.avg((F.col(m) >= 0 if m == "mae" else F.col(m) <= 0).cast("int")).alias(m) for m in METRICS])
    share = share.unpivot([], METRICS, "metric", "p")
    return ci.join(share, "metric").select("metric", *[rounded(F.col(c)).alias(c) for c in ("mean", "ci_low", "ci_high", "p")])


PAIRED = """SELECT entity, avg(price) FILTER (season < 1998) AS x, avg(price) FILTER (season >= 1998) AS y FROM history GROUP BY 1
  HAVING count(*) FILTER (season < 1998) > 0 AND count(*) FILTER (season >= 1998) > 0"""
VALUES = f"""SELECT d.b, p.x, p.y FROM (SELECT b, {wide_of(f"'{SEED}'", 'b', 'i')} % (SELECT count(*) FROM paired) AS u
  FROM range({B}) r(b), range((SELECT count(*) FROM paired)) s(i)) d JOIN (SELECT *, row_number() OVER (ORDER BY entity) - 1 AS i FROM paired) p ON p.i = d.u"""


def paired(spark, sf):
    early = F.col("season") < 1998
    return history(spark, sf).groupBy("entity").agg(
        F.avg(F.when(early, F.col("price"))).alias("x"), F.avg(F.when(~early, F.col("price"))).alias("y")).dropna()


@job("bootstrap_ratio", sql(f"""
SELECT {rnd('(SELECT avg(y) / avg(x) FROM paired)')} AS observed, {rnd('avg(r)')} AS mean, {rnd('stddev_pop(r)')} AS se, {rnd('quantile_cont(r, 0.025)')} AS ci_low, {rnd('quantile_cont(r, 0.975)')} AS ci_high
FROM (SELECT b, avg(y) / avg(x) AS r FROM drawn GROUP BY b)""", "history", paired=PAIRED, drawn=VALUES))
def bootstrap_ratio(spark, sf):
    p = materialized(paired(spark, sf))
    ratios = rs.bootstrap_means(p, "entity", ["x", "y"], B, SEED).select(safe_div(F.col("y"), F.col("x")).alias("ratio"))
    observed = p.agg(safe_div(F.avg("y"), F.avg("x"))).scalar()
    ci = rs.percentile_ci(ratios, ["ratio"])
    return ci.select(rounded(observed).alias("observed"), rounded(F.col("mean")).alias("mean"), rounded(F.col("sd")).alias("se"),
                     rounded(F.col("ci_low")).alias("ci_low"), rounded(F.col("ci_high")).alias("ci_high"))


@job("bootstrap_median", sql(f"""
SELECT {rnd('(SELECT median(y / x) FROM paired)')} AS observed, {rnd('avg(m)')} AS mean, {rnd('quantile_cont(m, 0.025)')} AS ci_low, {rnd('quantile_cont(m, 0.975)')} AS ci_high
FROM (SELECT b, median(y / x) AS m FROM drawn GROUP BY b)""", "history", paired=PAIRED, drawn=VALUES))
def bootstrap_median(spark, sf):
    from dwellkit.operators.running import exact_quantiles

    p = materialized(paired(spark, sf).select("entity", (F.col("y") / F.col("x")).alias("ratio")))
    observed = exact_quantiles(p, "ratio", {"m": 0.5}).scalar()
    ci = rs.percentile_ci(rs.bootstrap_median(p, "entity", "ratio", B, SEED), ["median"])
    return ci.select(rounded(observed).alias("observed"), *[rounded(F.col(c)).alias(c) for c in ("mean", "ci_low", "ci_high")])


def _side_sql(side):
    return f"""SELECT d.b, median(p.v) AS m FROM (SELECT b, {wide_of(f"'{SEED}{side}'", 'b', 'i')} % (SELECT count(*) FROM {side}) AS u
      FROM range({B}) r(b), range((SELECT count(*) FROM {side})) s(i)) d JOIN {side} p ON p.i = d.u GROUP BY 1"""


SIDES = {side: f"""SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_acctbal AS v FROM customer
  WHERE c_mktsegment {op} 'BUILDING'""" for side, op in (("a", "="), ("b", "<>"))}


@job("bootstrap_median_diff", sql(f"""
SELECT {rnd('avg(x.m - y.m)', 4)} AS mean, {rnd('quantile_cont(x.m - y.m, 0.025)', 4)} AS ci_low, {rnd('quantile_cont(x.m - y.m, 0.975)', 4)} AS ci_high
FROM x JOIN y USING (b)""", **SIDES, x=_side_sql("a"), y=_side_sql("b")))
def bootstrap_median_diff(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    diffs = rs.bootstrap_median_diff(c, "c_custkey", "c_acctbal", F.col("c_mktsegment") == "BUILDING", B, SEED)
    ci = rs.percentile_ci(diffs, ["diff"])
    return ci.select(*[rounded(F.col(x), 4).alias(x) for x in ("mean", "ci_low", "ci_high")])


SHUFFLES = 10000
PERM = f"""SELECT b, avg(price) FILTER (i >= k) - avg(price) FILTER (i < k) AS diff FROM (
  SELECT b, price, row_number() OVER (PARTITION BY b ORDER BY {wide_of(f"'{SEED}'", 'b', 'record')}) - 1 AS i, (SELECT count(*) FROM sample WHERE status = 'F') AS k
  FROM sample, range({SHUFFLES}) r(b)) GROUP BY b"""
OBSERVED = "(SELECT avg(price) FILTER (status = 'O') - avg(price) FILTER (status = 'F') FROM sample)"


@job("permutation_test", sql(f"SELECT {rnd(OBSERVED, 4)} AS observed, {rnd(f'avg(CAST(diff >= {OBSERVED} AS INTEGER))')} AS p, count(*) AS n_shuffles FROM perm",
                             "history", sample="SELECT * FROM history WHERE status IN ('F', 'O')", perm=PERM))
def permutation_test(spark, sf):
    s = history(spark, sf).filter(F.col("status").isin("F", "O"))
    out = rs.permutation_test(s, "record", "price", F.col("status") == "F", SHUFFLES, SEED)
    return out.select(rounded(F.col("observed"), 4).alias("observed"), rounded(F.col("p")).alias("p"), "n_shuffles")


# One value per seed and model, as repeated train/test splits give them.
J = 50
BY_SEED = f"""SELECT seed, avg(duration) AS a, avg(2.0 * label + 1.2) AS b FROM (SELECT CAST(seed AS INTEGER) AS seed, duration, label
  FROM targets, range({J}) r(seed) WHERE {int_of('seed', 'entity')} % 5 = 0) GROUP BY 1"""
T9 = t_quantile(0.975, J - 1)
NB = f"(1.0 / {J} + 0.25)"


def by_seed(spark, sf):
    t = targets(spark, sf).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(J - 1))))
    held = t.filter(hash_int(F.col("seed"), F.col("entity")) % 5 == 0)
    return held.groupBy("seed").agg(F.avg("duration").alias("a"), F.avg(2.0 * F.col("label") + 1.2).alias("b"))


def _models(spark, sf):
    return by_seed(spark, sf).unpivot(["seed"], ["a", "b"], "model", "value")


def _interval_sql(factor):
    return " UNION ALL ".join(f"""SELECT '{m}' AS model, count(*) AS n, {rnd(f'avg({m})')} AS mean, {rnd(f'stddev_samp({m})')} AS sd,
      {rnd(f'avg({m}) - {T9!r} * stddev_samp({m}) * sqrt({factor})')} AS ci_low, {rnd(f'avg({m}) + {T9!r} * stddev_samp({m}) * sqrt({factor})')} AS ci_high FROM by_seed""" for m in "ab")


def _rounded_all(df, keep, cols):
    return df.select(*keep, *[rounded(F.col(c)).alias(c) for c in cols])


@job("t_interval", sql(_interval_sql(f"1.0 / {J}"), "targets", by_seed=BY_SEED))
def t_interval(spark, sf):
    return _rounded_all(hy.t_interval(_models(spark, sf), ["model"], "value"), ["model", "n"], ["mean", "sd", "ci_low", "ci_high"])


@job("nb_interval", sql(_interval_sql(NB), "targets", by_seed=BY_SEED))
def nb_interval(spark, sf):
    return _rounded_all(hy.t_interval(_models(spark, sf), ["model"], "value", FRACTION), ["model", "n"], ["mean", "sd", "ci_low", "ci_high"])


def t_upper(t, df):
    """Upper tail of t for an odd number of degrees of freedom, in closed form: a sum of powers of a cosine."""
    th = f"atan({t} / sqrt({float(df)}))"
    terms, factor = [], 1.0
    for power in range(1, df - 1, 2):
        terms.append(f"{factor!r} * pow(cos({th}), {power})")
        factor *= (power + 1) / (power + 2)
    return f"(0.5 - ({th} + sin({th}) * ({' + '.join(terms)})) / pi())"


def _ttest_sql(factor):
    t = f"(avg(a - b) / sqrt({factor} * var_samp(a - b)))"
    return f"""SELECT count(*) AS n, {rnd('avg(a - b)')} AS mean, {rnd(t)} AS t, {rnd('2 * ' + t_upper(f'abs({t})', J - 1))} AS p_two_sided, {rnd(t_upper(t, J - 1))} AS p_greater FROM by_seed"""


@job("nb_ttest", sql(_ttest_sql(NB), "targets", by_seed=BY_SEED))
def nb_ttest(spark, sf):
    d = by_seed(spark, sf).select((F.col("a") - F.col("b")).alias("d"))
    return _rounded_all(hy.ttest_one(d, [], "d", FRACTION), ["n"], ["mean", "t", "p_two_sided", "p_greater"])


@job("ttest_paired", sql(_ttest_sql(f"(1.0 / {J})"), "targets", by_seed=BY_SEED))
def ttest_paired(spark, sf):
    d = by_seed(spark, sf).select((F.col("a") - F.col("b")).alias("d"))
    return _rounded_all(hy.ttest_one(d, [], "d"), ["n"], ["mean", "t", "p_two_sided", "p_greater"])


@job("ttest_welch", sql(f"""
SELECT n1, n2, {rnd('m1', 4)} AS m1, {rnd('m2', 4)} AS m2, {rnd('(m1 - m2) / sqrt(e1 + e2)')} AS t, {rnd('(e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1))', 3)} AS df
FROM (SELECT count(*) FILTER (status = 'F') AS n1, count(*) FILTER (status <> 'F') AS n2, avg(price) FILTER (status = 'F') AS m1, avg(price) FILTER (status <> 'F') AS m2,
  var_samp(price) FILTER (status = 'F') / count(*) FILTER (status = 'F') AS e1, var_samp(price) FILTER (status <> 'F') / count(*) FILTER (status <> 'F') AS e2 FROM history)""", "history"))
def ttest_welch(spark, sf):
    out = hy.ttest_welch(history(spark, sf), "price", F.col("status") == "F")
    return out.select("n1", "n2", rounded(F.col("m1"), 4).alias("m1"), rounded(F.col("m2"), 4).alias("m2"),
                      rounded(F.col("t")).alias("t"), rounded(F.col("df"), 3).alias("df"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _u_sql(a, b, col="priority", src="history"):
    return f"""SELECT '{a}' AS first, '{b}' AS second, r1 - n1 * (n1 + 1) / 2.0 AS u, n1, n2, ties FROM (
      SELECT sum(rk) FILTER ({col} = '{a}') AS r1, CAST(count(*) FILTER ({col} = '{a}') AS DOUBLE) AS n1, CAST(count(*) FILTER ({col} = '{b}') AS DOUBLE) AS n2,
        sum(CAST(c AS DOUBLE) * c - 1) AS ties FROM (SELECT {col}, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY v) AS c
        FROM (SELECT {col}, round(price, -2) AS v FROM {src}) WHERE {col} IN ('{a}', '{b}')))"""


SD = "sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))))"
Z1, Z2 = f"((u - n1 * n2 / 2.0 - 0.5) / {SD})", f"(greatest(abs(u - n1 * n2 / 2.0) - 0.5, 0) / {SD})"
EFFECT = "1 - 2 * u / (n1 * n2)"
U_COLS = f"""first, second, {rnd('u', 1)} AS u, {rnd('z1')} AS z, {rnd(f'CASE WHEN z1 >= 0 THEN {two_sided("z1")} / 2 ELSE 1 - {two_sided("z1")} / 2 END')} AS p_greater,
  {rnd(f'least({two_sided("z2")}, 1)')} AS p_two_sided, {rnd('eff')} AS rank_biserial,
  CASE WHEN abs(eff) < 0.1 THEN 'negligible' WHEN abs(eff) < 0.3 THEN 'small' WHEN abs(eff) < 0.5 THEN 'medium' ELSE 'large' END AS effect"""
U_ROUND = [("u", 1), ("z", 6), ("p_greater", 6), ("p_two_sided", 6), ("rank_biserial", 6)]


def _rank_sample(spark, sf):
    return history(spark, sf).select("priority", "status", F.round("price", -2).alias("price"))


@job("mannwhitney", sql(f"SELECT {U_COLS} FROM (SELECT *, {Z1} AS z1, {Z2} AS z2, {EFFECT} AS eff FROM x)", "history", x=_u_sql("F", "O", "status")))
def mannwhitney(spark, sf):
    out = hy.mannwhitney(_rank_sample(spark, sf), "price", "status", "F", "O")
    return out.select("first", "second", "effect", *[rounded(F.col(c), d).alias(c) for c, d in U_ROUND])


PAIRS = [(a, b) for i, a in enumerate(PRIORITIES) for b in PRIORITIES[i + 1:]]


@job("pairwise_bonferroni", sql(f"SELECT {U_COLS}, {two_sided('z2')} < 0.05 / {len(PAIRS)} AS significant FROM (SELECT *, {Z1} AS z1, {Z2} AS z2, {EFFECT} AS eff FROM x)",
                                "history", x=" UNION ALL ".join(_u_sql(a, b) for a, b in PAIRS)))
def pairwise_bonferroni(spark, sf):
    out = hy.pairwise_mannwhitney(_rank_sample(spark, sf), "price", "priority", PRIORITIES)
    return out.select("first", "second", "effect", "significant", *[rounded(F.col(c), d).alias(c) for c, d in U_ROUND])


@job("kruskal", sql(f"""
SELECT k - 1 AS df, {rnd('h')} AS h, {rnd('exp(-h / 2) * (1 + h / 2)')} AS p FROM (
  SELECT k, (12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - (SELECT sum(CAST(c AS DOUBLE) * c - 1) FROM ranked) / (n * n * n - n)) AS h
  FROM (SELECT count(*) AS k, CAST(sum(ni) AS DOUBLE) AS n, sum(ri * ri / ni) AS q FROM (SELECT priority, count(*) AS ni, sum(rk) AS ri FROM ranked GROUP BY 1)))""",
    "history", ranked="""SELECT priority, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY v) AS c
      FROM (SELECT priority, round(price, -2) AS v FROM history)"""))
def kruskal(spark, sf):
    return _rounded_all(hy.kruskal(_rank_sample(spark, sf), "price", "priority"), ["df"], ["h", "p"])


@job("wilcoxon_signed", sql(f"""
SELECT {rnd('wp', 1)} AS w_plus, {rnd('wm', 1)} AS w_minus, n, {rnd('z')} AS z, {rnd(f'CASE WHEN z >= 0 THEN {two_sided("z")} / 2 ELSE 1 - {two_sided("z")} / 2 END')} AS p_greater
FROM (SELECT *, (wp - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM (
  SELECT sum(rk) FILTER (d > 0) AS wp, sum(rk) FILTER (d < 0) AS wm, CAST(count(*) AS DOUBLE) AS n, sum(CAST(c AS DOUBLE) * c - 1) AS ties FROM (
    SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY abs(d)) AS c
    FROM (SELECT round(y - x, -3) AS d FROM paired) WHERE d <> 0)))""", "history", paired=PAIRED))
def wilcoxon_signed(spark, sf):
    d = paired(spark, sf).select(F.round(F.col("y") - F.col("x"), -3).alias("d"))
    out = hy.wilcoxon_signed(d, "d")
    return out.select("n", rounded(F.col("w_plus"), 1).alias("w_plus"), rounded(F.col("w_minus"), 1).alias("w_minus"),
                      rounded(F.col("z")).alias("z"), rounded(F.col("p_greater")).alias("p_greater"))


@job("ks_two_sample", sql(f"""
SELECT {rnd('max(abs(fa - fb))')} AS ks, max(n1) AS n1, max(n2) AS n2 FROM (
  SELECT CAST(sum(a) OVER (ORDER BY price) AS DOUBLE) / sum(a) OVER () AS fa, CAST(sum(b) OVER (ORDER BY price) AS DOUBLE) / sum(b) OVER () AS fb,
    CAST(sum(a) OVER () AS BIGINT) AS n1, CAST(sum(b) OVER () AS BIGINT) AS n2
  FROM (SELECT price, count(*) FILTER (status = 'F') AS a, count(*) FILTER (status = 'O') AS b FROM history WHERE status IN ('F', 'O') GROUP BY 1))""", "history"))
def ks_two_sample(spark, sf):
    out = hy.ks_two_sample(history(spark, sf), "price", "status", "F", "O")
    return out.select(rounded(F.col("ks")).alias("ks"), "n1", "n2")


@job("sign_test", sql(f"""
SELECT n_up, n, {rnd('(SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2.0))) FROM range(n_up, n + 1) r(k))')} AS p_greater
FROM (SELECT count(*) FILTER (y > x) AS n_up, count(*) AS n FROM paired)""", "history", paired=PAIRED))
def sign_test(spark, sf):
    return _rounded_all(hy.sign_test(paired(spark, sf), F.col("y") - F.col("x")), ["n_up", "n"], ["p_greater"])


@job("seed_summary", sql(" UNION ALL ".join(f"""SELECT '{m}' AS model, count(*) AS n, {rnd(f'avg({m})')} AS mean, {rnd(f'stddev_pop({m})')} AS sd, {rnd(f'min({m})')} AS low, {rnd(f'max({m})')} AS high,
  {rnd(f'quantile_cont({m}, 0.025)')} AS p025, {rnd(f'quantile_cont({m}, 0.975)')} AS p975, count(*) FILTER ({m} > {o}) AS wins FROM by_seed""" for m, o in ("ab", "ba")), "targets", by_seed=BY_SEED))
def seed_summary(spark, sf):
    wide = materialized(by_seed(spark, sf))
    long = wide.withColumn("_m", F.explode(F.array(*[F.struct(
        F.lit(m).alias("model"), F.col(m).alias("value"), (F.col(m) > F.col(o)).cast("int").alias("win")) for m, o in ("ab", "ba")])))
    long = long.select("_m.*")
    out = hy.seed_summary(long, ["model"], "value").join(long.groupBy("model").agg(F.sum("win").alias("wins")), "model")
    return _rounded_all(out, ["model", "n", "wins"], ["mean", "sd", "low", "high", "p025", "p975"])
