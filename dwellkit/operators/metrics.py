"""Metrics of ordinal, probabilistic and continuous predictions.

Class metrics come from one pass of conditional counts (K x K sums); rank metrics from
counts of distinct scores and running sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellkit.functions.numeric import bin_right_closed, safe_div
from dwellkit.operators.aggregates import unpivot_row
from dwellkit.operators.running import average_ranks, exact_quantiles, running
from dwellkit.session import materialized


def _add(cols):
    return reduce(lambda a, b: a + b, cols)


def _cells(df: DataFrame, truth: str, pred: str, k: int, n: Column | None = None, by: list[str] | None = None):
    """One row (per group) with the K x K counts as columns c_i_j."""
    n = F.lit(1) if n is None else n
    aggs = [F.sum(F.when((F.col(truth) == i) & (F.col(pred) == j), n).otherwise(0)).alias(f"c_{i}_{j}")
            for i in range(k) for j in range(k)]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def confusion_matrix(df: DataFrame, truth: str, pred: str, k: int) -> DataFrame:
    """All K x K cells including empty ones, with the share of the truth row."""
    one = _cells(df, truth, pred, k)
    rows = []
    for i in range(k):
        total = _add([F.col(f"c_{i}_{j}") for j in range(k)])
        for j in range(k):
            rows.append(F.struct(F.lit(i).alias("truth"), F.lit(j).alias("predicted"), F.col(f"c_{i}_{j}").alias("n"),
                                 F.coalesce(safe_div(F.col(f"c_{i}_{j}"), total), F.lit(0.0)).alias("row_share")))
    return one.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def qwk_expr(truth: Column, pred: Column, n: Column | None = None) -> Column:
    """Quadratic weighted kappa as one aggregate expression.

    sum_ij (i-j)^2 h_i g_j expands to N(sum t^2 + sum p^2) - 2 sum t sum p, and the factor
    (K-1)^2 cancels, so no confusion matrix is needed. Expected zero gives 1 or 0.
    """
    n = F.lit(1) if n is None else n
    t, p = truth.cast("double"), pred.cast("double")
    total = F.sum(n).cast("double")
    observed = F.sum((t - p) * (t - p) * n)
    expected = safe_div(total * (F.sum(t * t * n) + F.sum(p * p * n)) - 2.0 * F.sum(t * n) * F.sum(p * n), total)
    kappa = 1.0 - safe_div(observed, expected)
    return (F.when(total.isNull() | (total == 0), 0.0)
            .when(expected == 0, F.when(observed == 0, 1.0).otherwise(0.0)).otherwise(kappa))


def _prf(k: int):
    """Per class (precision, recall, f1, support, present) over the c_i_j columns."""
    zero = F.lit(0.0)
    out = []
    for i in range(k):
        tp = F.col(f"c_{i}_{i}")
        sup = _add([F.col(f"c_{i}_{j}") for j in range(k)])
        said = _add([F.col(f"c_{j}_{i}") for j in range(k)])
        prec, rec = F.coalesce(safe_div(tp, said), zero), F.coalesce(safe_div(tp, sup), zero)
        f1 = F.coalesce(safe_div(2.0 * tp, said + sup), zero)
        out.append((prec, rec, f1, sup, (sup + said) > 0))
    return out


def per_class_prf(df: DataFrame, truth: str, pred: str, k: int) -> DataFrame:
    """Precision, recall, F1 and support per class; zero where undefined."""
    one = _cells(df, truth, pred, k)
    return unpivot_row(one, {str(i): {"precision": p, "recall": r, "f1": f, "support": s}
                             for i, (p, r, f, s, _) in enumerate(_prf(k))}, "class")


def macro_f1(k: int) -> Column:
    """Mean F1 over the classes that occur in truth or prediction."""
    per = _prf(k)
    return safe_div(_add([F.when(here, f).otherwise(0.0) for _, _, f, _, here in per]),
                    _add([here.cast("int") for *_, here in per]))


def ordinal_summary(df: DataFrame, truth: str, pred: str, k: int, n: str | None = None,
                    by: list[str] | None = None) -> DataFrame:
    """MAE, QWK, adjacent and exact accuracy and macro F1; ``n`` is a row multiplicity."""
    w = F.lit(1) if n is None else F.col(n)
    miss = F.abs(F.col(truth) - F.col(pred)).cast("double")
    total = F.sum(w).cast("double")
    cell = [F.sum(F.when((F.col(truth) == i) & (F.col(pred) == j), w).otherwise(0)).alias(f"c_{i}_{j}")
            for i in range(k) for j in range(k)]
    aggs = [safe_div(F.sum(miss * w), total).alias("mae"), qwk_expr(F.col(truth), F.col(pred), w).alias("qwk"),
            safe_div(F.sum(F.when(miss <= 1, w).otherwise(0)), total).alias("adjacent_accuracy"),
            safe_div(F.sum(F.when(miss == 0, w).otherwise(0)), total).alias("exact_accuracy"),
            F.count_distinct(truth).alias("n_classes"), *cell]
    one = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return one.withColumn("macro_f1", macro_f1(k)).drop(*[f"c_{i}_{j}" for i in range(k) for j in range(k)])


def auroc_ovr(df: DataFrame, truth: str, scores: dict[int, str]) -> DataFrame:
    """One-vs-rest AUROC per class from average ranks; NULL when a class has no rows."""
    options = F.array(*[F.struct(F.lit(c).alias("class"), F.col(s).cast("double").alias("score"),
                                 (F.col(truth) == c).cast("int").alias("pos")) for c, s in scores.items()])
    long = df.select(F.explode(options).alias("_o")).select("_o.*")
    counts = long.groupBy("class", "score").agg(F.sum("pos").alias("n_pos"),
                                                (F.count(F.lit(1)) - F.sum("pos")).alias("n_neg"))
    run = running(counts, "score", {"neg": F.col("n_neg")}, ["class"])
    won = F.sum(F.col("n_pos") * (F.col("neg_before") + F.col("n_neg") / 2.0))
    pairs = F.sum("n_pos").cast("double") * F.max("neg_total")
    return run.groupBy("class").agg(
        safe_div(won, pairs).alias("auroc"), F.sum("n_pos").alias("support"))


def macro_auroc(per_class: DataFrame) -> DataFrame:
    """Mean over classes, NULL if any is undefined."""
    return per_class.agg(F.when(F.count("auroc") == F.count(F.lit(1)), F.avg("auroc")).alias("auroc_macro"))


def regression_summary(df: DataFrame, truth: str, pred: str) -> DataFrame:
    err = F.col(truth) - F.col(pred)
    mse = F.avg(err * err)
    return df.agg(F.avg(F.abs(err)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
                  (1.0 - safe_div(mse, F.var_pop(truth))).alias("r2"), F.corr(truth, pred).alias("correlation"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks; the rank mean (N + 1) / 2 is known beforehand."""
    pairs = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    cells = materialized(pairs.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_n")))

    def ranks(col, name):
        r = average_ranks(cells.groupBy(col).agg(F.sum("_n").alias("n")), col)
        return r.select(col, (F.col("avg_rank") - (F.col("n_all") + 1) / 2.0).alias(name))
    both = cells.join(ranks("_x", "rx"), "_x").join(ranks("_y", "ry"), "_y")
    n, rx, ry = F.col("_n"), F.col("rx"), F.col("ry")
    return both.agg(safe_div(F.sum(n * rx * ry), F.sqrt(F.sum(n * rx * rx)) * F.sqrt(F.sum(n * ry * ry))).alias("rho"),
                    F.sum(n).alias("n"))


def subgroup_metrics(df: DataFrame, truth: str, pred: str, groupings: dict[str, Column]) -> DataFrame:
    """Error metrics for several groupings of the same rows in one pass."""
    options = F.array(*[F.struct(F.lit(g).alias("grouping"), e.cast("string").alias("subgroup"))
                        for g, e in groupings.items()])
    err = F.col(pred) - F.col(truth)
    long = df.select(F.explode(options).alias("_g"), err.alias("_e"), F.col(truth).alias("_t"), F.col(pred).alias("_p"))
    long = long.select("_g.*", "_e", F.abs("_e").alias("_a"), "_t", "_p").filter(F.col("subgroup").isNotNull())
    keys = ["grouping", "subgroup"]
    base = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_a").alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.avg("_e").alias("bias"), F.avg("_t").alias("mean_truth"), F.avg("_p").alias("mean_pred"))
    return base.join(exact_quantiles(long, "_a", {"median_ae": 0.5}, keys), keys)


def constant_baseline(df: DataFrame, truth: str, always: int, k: int) -> DataFrame:
    """Macro F1 and AUROC of always predicting one class."""
    one = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == always).alias("hit"))
    precision = safe_div(F.col("hit"), F.col("n"))
    f1 = F.when(F.col("hit") > 0, safe_div(2.0 * precision, precision + 1.0)).otherwise(0.0)
    return one.select(precision.alias("precision"), f1.alias("f1"), (f1 / k).alias("macro_f1"), F.lit(0.5).alias("auroc"))


def regress_then_bin(value: Column, edges: list[float]) -> Column:
    """Round half to even, at least one season, then the ordinal bins."""
    return bin_right_closed(F.greatest(F.lit(1.0), F.bround(value, 0)), edges)


