"""Tests on means and ranks.

Rank tests use a table of distinct values with counts per sample and running sums over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellkit.functions.dist import binom_sf_col, chi2_sf_col, t_quantile_col, t_sf_col, t_two_sided
from dwellkit.functions.numeric import normal_two_sided, safe_div
from dwellkit.operators.running import average_ranks, running


def t_interval(df: DataFrame, by: list[str], value: str, test_fraction: float | None = None, level: float = 0.95) -> DataFrame:
    """mean +- t * sd * sqrt(factor); the factor is 1/n, plus rho/(1-rho) when the values come
    from J overlapping train/test splits with test fraction rho."""
    base = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    factor = F.lit(1.0) / F.col("n")
    if test_fraction is not None:
        factor = factor + F.lit(test_fraction / (1.0 - test_fraction))
    t = t_quantile_col(F.lit(0.5 + level / 2), (F.col("n") - 1).cast("double"))
    half = t * F.col("sd") * F.sqrt(factor)
    return base.withColumn("_half", half).select(*by, "n", "mean", "sd", (F.col("mean") - F.col("_half")).alias("ci_low"),
                                                 (F.col("mean") + F.col("_half")).alias("ci_high"))


def ttest_one(df: DataFrame, by: list[str], value: str, test_fraction: float | None = None) -> DataFrame:
    """One-sample (paired) t statistic with two- and one-sided p; Nadeau-Bengio variance
    when ``test_fraction`` is given."""
    base = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("_v"))
    factor = F.lit(1.0) / F.col("n")
    if test_fraction is not None:
        factor = factor + F.lit(test_fraction / (1.0 - test_fraction))
    out = base.withColumn("t", F.when(F.col("_v") > 0, safe_div(F.col("mean"), F.sqrt(factor * F.col("_v")))))
    dof = (F.col("n") - 1).cast("double")
    return (out.withColumn("p_two_sided", t_two_sided(F.col("t"), dof))
            .withColumn("p_greater", t_sf_col(F.col("t"), dof)).drop("_v"))


def ttest_welch(df: DataFrame, value: str, first: Column) -> DataFrame:
    """Unequal-variance t test of the first sample against the others."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    m = df.agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"),
               F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    m = m.withColumn("t", safe_div(F.col("m1") - F.col("m2"), F.sqrt(e1 + e2)))
    m = m.withColumn("df", safe_div((e1 + e2) * (e1 + e2), e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1)))
    return m.withColumn("p", t_two_sided(F.col("t"), F.col("df"))).drop("v1", "v2")


def _effect(r: Column) -> Column:
    a = F.abs(r)
    return (F.when(a < 0.1, "negligible").when(a < 0.3, "small").when(a < 0.5, "medium").otherwise("large"))


def _u_result(df: DataFrame) -> DataFrame:
    """From u, n1, n2 and the tie term: tie-corrected z (continuity 1/2), p values and the
    rank-biserial effect. Steps are columns, so no expression is expanded many times."""
    u, n1, n2 = F.col("u"), F.col("n1"), F.col("n2")
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - safe_div(F.col("ties"), n * (n - 1))))
    df = df.withColumn("_sd", sd).withColumn("_gap", u - n1 * n2 / 2.0)
    df = (df.withColumn("z", safe_div(F.col("_gap") - 0.5, F.col("_sd")))
          .withColumn("_z2", safe_div(F.greatest(F.abs("_gap") - 0.5, F.lit(0.0)), F.col("_sd"))))
    df = (df.withColumn("_half", normal_two_sided(F.col("z")) / 2.0)
          .withColumn("p_two_sided", F.least(normal_two_sided(F.col("_z2")), F.lit(1.0))))
    return (df.withColumn("p_greater", F.when(F.col("z") >= 0, F.col("_half")).otherwise(1.0 - F.col("_half")))
            .withColumn("rank_biserial", 1.0 - safe_div(2.0 * u, n1 * n2))
            .withColumn("effect", _effect(F.col("rank_biserial")))
            .drop("_sd", "_gap", "_z2", "_half", "ties", "n1", "n2"))


def sample_counts(df: DataFrame, value: str, sample: str, samples: list) -> DataFrame:
    """(value, n, n_0, n_1, ...): distinct values with counts per listed sample."""
    return (df.filter(F.col(sample).isin(samples) & F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value"))
            .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(sample) == s).alias(f"n_{i}") for i, s in enumerate(samples)]))


def pairwise_mannwhitney(df: DataFrame, value: str, sample: str, samples: list, alpha: float = 0.05) -> DataFrame:
    """All pairs of samples, Bonferroni-corrected, from one pass of running counts."""
    counts = sample_counts(df, value, sample, samples)
    k = len(samples)
    run = running(counts, "value", {f"b{i}": F.col(f"n_{i}") for i in range(k)})
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    aggs = [F.sum(f"n_{i}").alias(f"t_{i}") for i in range(k)]
    for i, j in pairs:
        # Pairs in which i is larger, ties one half; and the tie term of the two samples.
        aggs.append(F.sum(F.col(f"n_{i}") * (F.col(f"b{j}_before") + F.col(f"n_{j}") / 2.0)).alias(f"u_{i}_{j}"))
        t = (F.col(f"n_{i}") + F.col(f"n_{j}")).cast("double")
        aggs.append(F.sum(t * t * t - t).alias(f"w_{i}_{j}"))
    one = run.agg(*aggs)
    rows = [F.struct(F.lit(samples[i]).alias("first"), F.lit(samples[j]).alias("second"), F.col(f"u_{i}_{j}").alias("u"),
                     F.col(f"t_{i}").cast("double").alias("n1"), F.col(f"t_{j}").cast("double").alias("n2"),
                     F.col(f"w_{i}_{j}").alias("ties")) for i, j in pairs]
    out = _u_result(one.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*"))
    return out.withColumn("significant", F.col("p_two_sided") < alpha / max(1, len(pairs)))


def mannwhitney(df: DataFrame, value: str, sample: str, first, second) -> DataFrame:
    return pairwise_mannwhitney(df, value, sample, [first, second]).drop("significant")


def kruskal(df: DataFrame, value: str, sample: str) -> DataFrame:
    """H with tie correction over all samples present, degrees of freedom and p."""
    cells = (df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value"), F.col(sample).alias("_s"))
             .agg(F.count(F.lit(1)).alias("_k")))
    by_value = cells.groupBy("value").agg(F.sum("_k").alias("n"), F.collect_list(F.struct("_s", "_k")).alias("_parts"))
    ranks = average_ranks(by_value, "value")  # the list is as long as there are samples
    # Sum over values of n^3 - n, split over the samples: each row of a tie of n adds n^2 - 1.
    k, tied = F.col("_p._k"), F.col("n").cast("double")
    sums = (ranks.select("avg_rank", "n", "n_all", F.explode("_parts").alias("_p"))
            .groupBy("_p._s").agg(F.sum(k).alias("ni"), F.sum(k * F.col("avg_rank")).alias("ri"),
                                  F.sum(k * (tied * tied - 1)).alias("ti"), F.max("n_all").alias("n_all")))
    out = sums.agg(F.sum(F.col("ri") * F.col("ri") / F.col("ni")).alias("_q"), (F.count(F.lit(1)) - 1).alias("df"),
                   F.sum("ti").alias("_t"), F.max("n_all").cast("double").alias("_n"))
    n = F.col("_n")
    tie = 1.0 - safe_div(F.col("_t"), n * n * n - n)
    out = out.withColumn("h", safe_div((12.0 / (n * (n + 1))) * F.col("_q") - 3.0 * (n + 1), tie)).drop("_q", "_t", "_n")
    return out.withColumn("p", chi2_sf_col(F.col("h"), F.col("df").cast("double")))


def wilcoxon_signed(df: DataFrame, diff: str) -> DataFrame:
    """Signed-rank sums with zeros dropped, tie-corrected z and p."""
    counts = (df.filter(F.col(diff) != 0).groupBy(F.abs(F.col(diff)).alias("value"))
              .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(diff) > 0).alias("n_up")))
    r = average_ranks(counts, "value")
    n = F.max("n_all").cast("double")
    one = r.agg(F.sum(F.col("n_up") * F.col("avg_rank")).alias("w_plus"),
                F.sum((F.col("n") - F.col("n_up")) * F.col("avg_rank")).alias("w_minus"), n.alias("n"),
                F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("_t"))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_t") / 48.0)
    one = one.withColumn("z", safe_div(F.col("w_plus") - n * (n + 1) / 4.0, sd)).drop("_t")
    half = normal_two_sided(F.col("z")) / 2.0
    return one.withColumn("p_greater", F.when(F.col("z") >= 0, half).otherwise(1.0 - half))


def ks_two_sample(df: DataFrame, value: str, sample: str, first, second) -> DataFrame:
    """Largest gap between the two distribution functions."""
    run = running(sample_counts(df, value, sample, [first, second]), "value", {"a": F.col("n_0"), "b": F.col("n_1")})
    fa = safe_div(F.col("a_before") + F.col("n_0"), F.col("a_total"))
    fb = safe_div(F.col("b_before") + F.col("n_1"), F.col("b_total"))
    return run.agg(F.max(F.abs(fa - fb)).alias("ks"), F.max("a_total").alias("n1"), F.max("b_total").alias("n2"))


def sign_test(df: DataFrame, diff: Column) -> DataFrame:
    """One-sided binomial tail that the difference is positive more often than not."""
    one = df.agg(F.count_if(diff > 0).alias("n_up"), F.count(diff).alias("n"))
    return one.withColumn("p_greater", binom_sf_col(F.col("n_up").cast("double"), F.col("n").cast("double")))


def seed_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, sd, min, max and 2.5 / 97.5 percentile over seeds or folds (a bounded number)."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("low"),
        F.max(value).alias("high"), F.percentile(value, F.lit(0.025)).alias("p025"), F.percentile(value, F.lit(0.975)).alias("p975"))
