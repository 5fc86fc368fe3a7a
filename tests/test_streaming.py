from docweave import streaming
from docweave.operators.keyed import fingerprint
from docweave.sources.deltas import Store, Stores, merge_sink


def test_snapshots(spark, tmp_path):
    schema = "key string, version string, seq long, paths array<string>, texts array<string>"
    batches = [[("k", "1", 1, ["p"], ["a"])], [("k", "1", 2, ["p"], ["a"]), ("k", "2", 3, ["p"], ["b"])], [("k", "2", 4, ["p"], ["b"])]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert i >= 0
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streaming.snapshot_changes(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("changes").collect()] == [("k", "2", "1", "changed", "p", "a", "b")]


SNAPSHOTS = "key string, version string, seq long, paths array<string>, texts array<string>"


def run_to_the_end(changes, name, checkpoint, trigger, seconds=60):
    q = changes.writeStream.format("parquet").option("path", f"{checkpoint}-{name}").option("checkpointLocation", str(checkpoint)).trigger(**trigger).start()
    q.awaitTermination(seconds)
    q.stop()


def test_snapshots_go_on_from_a_store_and_a_checkpoint(spark, tmp_path):
    """Initial state counts as the last version; a query that is started again from its checkpoint knows what it has seen."""
    store = spark.createDataFrame([("k", "1", ["p", "q"], ["a", "b"]), ("m", "1", [], [])], "key string, version string, paths array<string>, texts array<string>")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SNAPSHOTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    batches = [[("k", "2", 1, ["p", "q"], ["a", "c"]), ("n", "1", 2, ["p"], ["x"])], [("k", "2", 3, ["p", "q"], ["a", "c"]), ("m", "2", 4, ["p"], ["new"])], [("k", "3", 5, ["q"], ["c"]), ("n", "2", 6, ["p"], ["y"])]]
    for rows in batches:
        spark.createDataFrame(rows, SNAPSHOTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # each time a query of its own, that ends
        run_to_the_end(streaming.snapshot_changes(stream, store), "out", tmp_path / "cp", {"availableNow": True})
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/cp-out").collect()]
    assert set(got) == {("k", "2", "1", "changed", "q", "b", "c"), ("m", "2", "1", "added", "p", None, "new"), ("k", "3", "2", "removed", "p", "a", None), ("n", "2", "1", "changed", "p", "x", "y")}
    assert len(got) == 4


def test_idle_keys_expire(spark, tmp_path):
    """A key that brings nothing any more goes with a row that says so, and begins anew."""
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SNAPSHOTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    changes = streaming.snapshot_changes(stream, idle_ms=1)
    for rows in ([("k", "1", 1, ["p"], ["a"])], [("other", "1", 2, ["p"], ["a"])], [("k", "2", 3, ["p"], ["b"])]):
        spark.createDataFrame(rows, SNAPSHOTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_to_the_end(changes, "out", tmp_path / "cp", {"processingTime": "100 milliseconds"}, 7)  # a query with timers goes on
    got = {(r.key, r.version, r.kind) for r in spark.read.parquet(f"{tmp_path}/cp-out").collect()}
    assert ("k", "1", "expired") in got and not [g for g in got if g[2] == "changed"]


def test_merge_sink_and_dedupe(spark, tmp_path):
    schema = "k long, v string, error string, ts timestamp"
    rows = spark.sql("SELECT id % 7 AS k, 'x' AS v, CASE WHEN id < 7 THEN 'parse' END AS error, timestamp '2024-01-01' AS ts FROM range(14)")
    for part in ("error IS NOT NULL", "error IS NULL"):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stores = Stores(spark, f"{tmp_path}/out", [Store("rows", ("k",), schema)])
    sink = merge_sink(stores, rows=lambda batch: (batch, "k"))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    last = stores.read("rows")
    assert stores.manifest()["number"] == 2 and last.count() == 7 and last.where("error IS NOT NULL").count() == 0
    before = fingerprint(last)
    sink(rows.where("error IS NULL"), 1)  # the batch again
    assert stores.manifest()["number"] == 2 and fingerprint(stores.read("rows")) == before
    q = streaming.deduplicated(stream.select("k", "ts"), ["k"], "ts").writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 7
    q = streaming.windowed_counts(stream, "ts", "1 day", ["v"]).writeStream.format("memory").outputMode("complete").queryName("days").option("checkpointLocation", f"{tmp_path}/cp3").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("days").first().n == 14


def test_fan_out_and_lock(spark, tmp_path):
    import os

    from docweave.operators.incremental import locked

    got = []
    streaming.fan_out(lambda df, n: got.append((n, df.count())), lambda df, n: got.append((n, df.first()[0])))(spark.range(5, 8), 3)
    assert got == [(3, 3), (3, 5)]
    path = str(tmp_path / "lock")
    with locked(spark, path) as mine:
        with locked(spark, path) as other:
            assert mine and not other
        assert os.path.exists(path)
        with locked(spark, path, stale=-1) as taken:
            assert taken
    assert not os.path.exists(path)
