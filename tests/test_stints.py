from pyspark.sql import functions as F

from dwellkit.operators import labels as lb
from dwellkit.operators import pit
from dwellkit.operators import stints as st
from dwellkit.operators.aggregates import slope_last_k, zscore_by_period
from dwellkit.plans.catalog import QUERIES


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_islands_gap_of_one_and_two_and_repeated_season(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 4), ("b", 7)], "e string, y int").distinct()
    out = st.stint_islands(df, "e", "y").select("e", "start_season", "end_season", "duration")
    assert rows(out, "e", "start_season") == [("a", 1, 2, 2), ("a", 4, 4, 1), ("b", 7, 7, 1)]


def test_islands_dimension_change_and_either_key(spark):
    df = spark.createDataFrame([("a", 1, "x", "p"), ("a", 2, "y", "p"), ("a", 3, "z", "q")], "e string, y int, k1 string, k2 string")
    one = st.stint_islands(df, "e", "y", ["k1"]).count()
    either = st.stint_islands(df, "e", "y", ["k1", "k2"], either=True).select("start_season", "end_season")
    assert one == 3
    assert rows(either, "start_season") == [(1, 2), (3, 3)]


def test_runs_forward_and_backward(spark):
    hist = spark.createDataFrame([("a", "k", y) for y in (1, 2, 2, 3, 6)], "e string, k string, y int")
    anchors = spark.createDataFrame([("a", "k", 2), ("a", "k", 4), ("a", "k", 6), ("a", "z", 2)], "e string, k string, a int")
    fwd = st.tenure_run_forward(anchors, hist, ["e", "k"], "a", "y").select("k", "a", "tenure")
    assert rows(fwd, "k", "a") == [("k", 2, 2), ("k", 4, None), ("k", 6, 1), ("z", 2, None)]
    back = st.run_backward(anchors, hist, ["e", "k"], "a", "y").select("k", "a", "run_length")
    assert rows(back, "k", "a") == [("k", 2, 1), ("k", 4, 3), ("k", 6, 0), ("z", 2, 0)]


def test_dedupe_keeps_first_and_all_unclassified(spark):
    df = spark.createDataFrame([("a", 1, "X", 2), ("a", 1, "X", 1), ("a", 1, "NONE", 3), ("a", 1, "NONE", 4)], "e string, y int, c string, o int")
    out = st.dedupe_keep_first(df, ["e", "y", "c"], ["o"], F.col("c") == "NONE")
    assert rows(out, "o") == [("a", 1, "X", 1), ("a", 1, "NONE", 3), ("a", 1, "NONE", 4)]


def test_mode_takes_smallest_label_on_ties(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("b", 3), ("b", 0)], "g string, l int")
    assert rows(st.mode_per_group(df, ["g"], "l").select("g", "modal"), "g") == [("a", 1), ("b", 3)]


def test_step_read_before_first_and_between(spark):
    curve = spark.createDataFrame([(2, 0.5), (4, 0.25)], "t int, s double")
    pts = spark.createDataFrame([(1,), (2,), (3,), (9,)], "p int")
    assert rows(st.step_read(pts, "p", curve, "t", "s", empty=1.0), "p") == [(1, 1.0), (2, 0.5), (3, 0.5), (9, 0.25)]


def test_asof_is_strictly_before(spark):
    hist = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y")], "e string, y int, v string")
    anchors = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 9), ("b", 2)], "e string, a int")
    out = pit.asof_before(anchors, hist, ["e"], "a", "y", ["v"]).select("e", "a", "last_v")
    assert rows(out, "e", "a") == [("a", 1, None), ("a", 2, "x"), ("a", 3, "x"), ("a", 9, "y"), ("b", 2, None)]


def test_interval_contains_takes_first_span(spark):
    spans = spark.createDataFrame([("a", 1, 4), ("a", 3, 6)], "e string, start_season int, end_season int")
    pts = spark.createDataFrame([("a", 3), ("a", 6), ("a", 9)], "e string, y int")
    out = pit.interval_contains(pts, spans, ["e"], "y").select("y", "start_season", "matched")
    assert rows(out, "y") == [(3, 1, True), (6, 3, True), (9, None, False)]


def test_zscore_null_zero_variance_and_single_unit(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", 5.0), (2, "b", 5.0), (3, "a", 2.0), (4, "a", 1.0), (4, "b", 3.0)], "y int, u string, v double")
    out = zscore_by_period(df, "y", ["v"])
    assert [r["v"] for r in out.orderBy("y", "u").collect()] == [None, None, None, None, None, -1.0, 1.0]
    kept = zscore_by_period(spark.createDataFrame([(1, 1.0), (1, None), (1, 3.0)], "y int, v double"), "y", ["v"], omit_missing=True)
    assert sorted((r["v"] is None, r["v"] or 0.0) for r in kept.collect()) == [(False, -1.0), (False, 1.0), (True, 0.0)]


def test_slope_needs_two_points_and_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 1.0), ("b", 2, None), ("b", 3, 4.0), ("c", 0, 100.0), ("c", 1, 1.0), ("c", 2, 2.0), ("c", 3, 3.0), ("d", 1, None)],
                               "e string, y int, v double")
    out = {r["e"]: (r["n_points"], r["slope"]) for r in slope_last_k(df, ["e"], "y", "v", 3).collect()}
    assert out["a"] == (1, None) and out["d"] == (0, None)
    assert out["b"] == (2, 3.0)
    assert out["c"][0] == 3 and abs(out["c"][1] - 1.0) < 1e-12


def test_anchor_kinds(spark):
    s = spark.createDataFrame([("a", 1, 3), ("b", 1, 2), ("c", 1, 2), ("d", 1, 1)], "e string, start_season int, end_season int")
    flags = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, False), ("b", 2, False), ("c", 1, True), ("d", 1, None)], "e string, y int, p boolean")
    out = lb.classify_anchor(s, flags, ["e"], "y", "p").select("e", "anchor_kind", "anchor")
    assert rows(out, "e") == [("a", "reanchor", 2), ("b", "interim_only", 1), ("c", "clean", 1), ("d", "clean", 1)]


def test_forward_mean_sentinel_only_for_recent(spark):
    hist = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 1.0), ("b", 9, 0.25)], "e string, y int, v double")
    anchors = spark.createDataFrame([("a", 1), ("a", 2), ("b", 9), ("c", 9), ("c", 1)], "e string, a int")
    out = pit.forward_mean(anchors, hist, ["e"], "a", "y", F.col("v"), recent_from=9).select("e", "a", "forward_mean")
    assert rows(out, "e", "a") == [("a", 1, 0.75), ("a", 2, 1.0), ("b", 9, 0.25), ("c", 1, None), ("c", 9, -1.0)]


def test_every_branch_of_the_labels_occurs(spark):
    sf = "/root/testdata/sf0.01"
    for name, columns in {"post_exit_signals": ["active_after", "head_elsewhere_after", "head_elsewhere_next"]}.items():
        rows = QUERIES[name](spark, sf).collect()
        for c in columns:
            assert {r[c] for r in rows} == {True, False}, (name, c)
    kinds = {r["kind"] for r in QUERIES["event_label_rules"](spark, sf).select("kind").distinct().collect()}
    assert kinds == {"active", "fired_notes", "resigned_notes", "losing_finale", "moved_team?", "voluntary_note?", "nonlosing_left?"}
    closed = QUERIES["close_previous"](spark, sf).withColumn("cut", F.coalesce(F.col("next_start") <= F.col("start_season") + F.col("closed_length"), F.lit(False)))
    assert {r["cut"] for r in closed.collect()} == {True, False}
    tenures = QUERIES["tenure_run_forward"](spark, sf)
    assert 0 < tenures.filter("tenure IS NULL").count() < tenures.count()
