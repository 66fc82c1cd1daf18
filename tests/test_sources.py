from pyspark.sql import functions as F

from dwellkit.operators.lookups import exact_then_substring
from dwellkit.operators.quality import cell_diff, key_set_diff
from dwellkit.plans.base import table
from dwellkit.sources import files, pages
from dwellkit.streaming import events as ev

SF = "/root/testdata/sf0.001"


def test_entity_dirs_and_header_variants(spark, tmp_path):
    for name, text in {"Ann Lee": "Year,Age,Role\n1990,40,Head\n1991,x,\"A, B\"\n", "Bo+Z": "Role,Year\nTail,1992\nShort\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "history.csv").write_text(text)
    (tmp_path / "Nobody").mkdir()
    (tmp_path / "Ann Lee" / "other.csv").write_text("Year\n1\n")
    out = files.read_by_header(spark, str(tmp_path), "history.csv", {"Year": "int", "Age": "int", "Role": "string"})
    got = [(r["Year"], r["Age"], r["Role"]) for r in out.orderBy("Year").collect()]
    assert got == [(None, None, "Short"), (1990, 40, "Head"), (1991, None, "A, B"), (1992, None, "Tail")]
    plain = files.read_entity_dirs(spark, str(tmp_path), "other.csv", "Year int")
    assert [tuple(r) for r in plain.collect()] == [(1, "Ann Lee")]


def test_season_table_is_pruned(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 5 + 2000).cast("int").alias("season"), "id")
    files.write_by_season(df, str(tmp_path / "t"), "season")
    one = files.read_season(spark, str(tmp_path / "t"), "season", 2003)
    assert one.count() == 20
    assert "PartitionFilters: [isnotnull(season" in one._jdf.queryExecution().toString()


def test_fill_forward_across_ranges(spark):
    df = spark.createDataFrame([("a", i, i if i in (1, 7) else None) for i in range(12)], "g string, o int, v int")
    out = [r["f"] for r in pages.fill_forward(df, ["g"], "o", F.col("v"), "f").orderBy("o").collect()]
    assert out == [None] + [1] * 6 + [7] * 5


def test_block_rows_inside_comments(spark):
    df = spark.createDataFrame([(1, "<!-- <li><a href='x'>y</a></li> --><li>head</li>")], "id int, html string")
    out = pages.block_rows(df, ["id"], "html", "li", ["href='([^']*)'"], skip="head").collect()
    assert [(r["row_no"], r["cell_0"]) for r in out] == [(0, "x")]


def test_header_suffixes(spark):
    names = ["Yds", "TD", "Yds", "TD", "Yds"]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "h int, i int, n string")
    out = [r["unique_name"] for r in pages.dedupe_headers(df, ["h"], "i", "n", ["Offense", "Defense"]).orderBy("i").collect()]
    assert out == ["Yds", "TD", "Yds Offense", "TD Defense", "Yds_2"]


def test_name_matching_steps(spark):
    left = spark.createDataFrame([("Al Smith",), ("Bo Smith",), ("Cy Nobody",), ("Di Son",)], "name string")
    dim = spark.createDataFrame([("Al Smith", 1), ("Zed Smithson", 2)], "dn string, v int")
    out = {r["name"]: (r["match_kind"], r["v"]) for r in exact_then_substring(left, "name", dim, "dn", {"v": 0}).collect()}
    assert out == {"Al Smith": ("exact", 1), "Bo Smith": ("token", 1), "Cy Nobody": ("none", 0), "Di Son": ("token", 2)}


def test_differences(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 1.0, None), (3, 1.0, "x"), (4, 1.0, "x")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.005, "x"), (2, 1.0, "y"), (3, 1.02, "z"), (5, 1.0, "x")], "k int, v double, s string")
    out = sorted((r["k"], r["column"], r["kind"]) for r in cell_diff(a, b, ["k"], ["v", "s"]).collect())
    assert out == [(2, "s", "null_change"), (3, "s", "other"), (3, "v", "numeric")]
    keys = {r["k"]: r["status"] for r in key_set_diff(a, b, ["k"]).collect()}
    assert keys == {1: "same", 2: "same", 3: "same", 4: "removed", 5: "added"}


def test_stream_stints_equal_batch(spark):
    gap = 6 * 3600 * 1_000_000
    batch = ev.session_stints(table(spark, SF, "events"), "user_id", "ts", gap)
    stream = ev.run_available(ev.session_stream(ev.read_stream(spark, SF, "events.parquet"), "user_id", "ts", gap, "1 hour"), partial_merge=True)
    done = {tuple(r) for r in stream.select("user_id", "start_us", "end_us", "n").collect()}
    every = {tuple(r) for r in batch.select("user_id", "start_us", "end_us", "n").collect()}
    assert done and done <= every
    last = max(r[2] for r in every)
    # Only stints whose end lies within gap + delay of the newest event are still open.
    assert all(r[2] + gap > last - 3_600_000_000 for r in every - done)


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "kind string, at timestamp_ntz, v double"
    one = "SELECT 'a' AS kind, TIMESTAMP_NTZ'{}' AS at, 1.0D AS v"
    folder = tmp_path / "in"
    for i, at in enumerate(["2024-01-01 00:10:00", "2024-01-02 00:00:00", "2024-01-01 00:20:00", "2024-01-03 00:00:00"]):
        spark.sql(one.format(at)).coalesce(1).write.mode("append").parquet(str(folder))
        src = spark.readStream.schema(schema).parquet(str(folder))
        q = (ev.counts_stream(src, "kind", "at", "v", "1 hour", "1 hour").writeStream.format("parquet")
             .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("start_us").collect()
    assert [r["n"] for r in out] == [1, 1]


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").coalesce(1)
    cut = events.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    folder, gap = tmp_path / "in", 6 * 3600 * 1_000_000
    seen = []
    for part in (events.filter(F.col("ts") <= cut), events.filter(F.col("ts") > cut)):
        part.write.mode("append").parquet(str(folder))
        src = spark.readStream.schema(events.schema).parquet(str(folder))
        out = ev.run_available(ev.session_stream(src, "user_id", "ts", gap, "1 hour"), path=str(tmp_path / "run"), partial_merge=True)
        seen.append({tuple(r) for r in out.select("user_id", "start_us", "end_us", "n").collect()})
    whole = ev.run_available(ev.session_stream(ev.read_stream(spark, SF, "events.parquet"), "user_id", "ts", gap, "1 hour"), partial_merge=True)
    # Stints that were open at the stop are whole in the end, and none is written twice.
    assert seen[0] < seen[1] == {tuple(r) for r in whole.select("user_id", "start_us", "end_us", "n").collect()}
    assert out.count() == len(seen[1])


def test_nan_is_a_missing_cell(spark):
    nan = float("nan")
    a = spark.createDataFrame([(1, nan), (2, nan), (3, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, nan), (2, 1.0), (3, None)], "k int, v double")
    assert sorted((r["k"], r["kind"]) for r in cell_diff(a, b, ["k"], ["v"]).collect()) == [(2, "null_change"), (3, "null_change")]
