"""Streams against their batch twins."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gristmill.operators import runlog as log_ops
from gristmill.plans.queries import QUERIES
from gristmill.session import new_folder
from gristmill.sources import tables
from gristmill.streaming import ingest, steps, throughput

FOLDER = "/root/testdata/sf0.001"


def files(spark, batches):
    """One Parquet file per batch of (doc_id, words)."""
    folder = new_folder(spark, "incoming")
    schema = "doc_id long, text string, source string"
    for batch in batches:
        rows = [(i, " ".join(["word"] * n), "s") for i, n in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.read.parquet(folder).schema


def run(spark, folder, schema, out, **settings):
    stream = ingest.stream_documents(spark, folder, schema, files_per_batch=1)
    ingest.incremental_ingest(stream, out, shortest=10, longest=1000, words_per_token=1.0, **settings)


def shards_of(spark, out):
    found = {}
    for row in ingest.ingested(spark, out).collect():
        found.setdefault(row.shard, []).append(row.doc_id)
    return {shard: sorted(ids) for shard, ids in sorted(found.items())}


def test_batches_number_on_and_stop_at_the_budget(spark):
    batches = [[(b * 10 + i, 10 + i) for i in range(7)] for b in range(4)]
    folder, schema = files(spark, batches)
    out = new_folder(spark, "out")
    run(spark, folder, schema, out, rows=3, target_tokens=150)
    manifest = ingest.ingest_manifest(spark, out).orderBy("shard").collect()
    assert [r.shard for r in manifest] == list(range(len(manifest)))
    total = sum(r.words for r in manifest)
    kept = ingest.ingested(spark, out)
    assert kept.count() == sum(r.num_rows for r in manifest)
    last = kept.agg(F.max("doc_id")).first()[0]
    assert total >= 150 > total - (10 + last % 10)
    # The open shard went on from batch to batch; only the last one is short.
    assert [r.num_rows for r in manifest][:-1] == [3] * (len(manifest) - 1)


def test_a_raised_target_takes_in_the_rest_once(spark):
    batches = [[(b * 5 + i, 10) for i in range(5)] for b in range(3)]
    folder, schema = files(spark, batches)
    out = new_folder(spark, "out")
    run(spark, folder, schema, out, rows=4, target_tokens=75)
    assert shards_of(spark, out) == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7]}
    run(spark, folder, schema, out, rows=4, target_tokens=75)
    assert shards_of(spark, out) == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7]}
    run(spark, folder, schema, out, rows=4, target_tokens=10_000)
    assert shards_of(spark, out) == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9, 10, 11], 3: [12, 13, 14]}


def test_a_repeated_batch_changes_nothing(spark):
    folder, schema = files(spark, [[(i, 20) for i in range(5)]])
    out = new_folder(spark, "out")
    docs = spark.read.schema(schema).parquet(folder)
    for _ in range(2):
        ingest.ingest_step(docs, 0, spark, out, rows=2, shortest=1)
    more = docs.withColumn("doc_id", F.col("doc_id") + 100)
    ingest.ingest_step(more, 1, spark, out, rows=2, shortest=1)
    ingest.ingest_step(docs, 0, spark, out, rows=2, shortest=1)
    ingest.ingest_step(None, -1, spark, out, rows=2, shortest=1)
    assert shards_of(spark, out) == {0: [0, 1], 1: [2, 3], 2: [4, 100], 3: [101, 102], 4: [103, 104]}


def test_a_step_without_its_manifest_is_done_again(spark):
    folder, schema = files(spark, [[(i, 20) for i in range(3)]])
    out = new_folder(spark, "out")
    docs = spark.read.schema(schema).parquet(folder)
    docs.withColumn("shard", F.lit(7)).write.partitionBy("shard").parquet(f"{out}/raw/step=0")
    ingest.ingest_step(docs, 0, spark, out, rows=2, shortest=1)
    assert shards_of(spark, out) == {0: [0, 1]}


def test_a_later_call_goes_on(spark):
    folder, schema = files(spark, [[(i, 20) for i in range(4)]])
    out = new_folder(spark, "out")
    run(spark, folder, schema, out, rows=2, target_tokens=10_000)
    spark.createDataFrame([(9, "word " * 20, "s")], schema).write.mode("append").parquet(folder)
    run(spark, folder, schema, out, rows=2, target_tokens=10_000)
    assert shards_of(spark, out) == {0: [0, 1], 1: [2, 3], 2: [9]}


def test_live_rates_equal_the_batch_twin(spark):
    schema = tables.table(spark, FOLDER, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(FOLDER)
    live = throughput.run_live_throughput(spark, tables.instants(events), new_folder(spark, "live"))
    batch = throughput.batch_throughput(tables.table_events(spark, FOLDER))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))
    assert live.count() > 0


def test_streams_of_tables_in_several_files(spark):
    """A table is a file in some folders and a folder of files in others."""
    for parts in (1, 3):
        folder = new_folder(spark, "tables")
        docs = spark.createDataFrame([(i, f"text {i}", "s") for i in range(9)], "doc_id long, text string, source string")
        docs.repartition(parts).write.parquet(f"{folder}/documents.parquet")
        start = datetime(2024, 1, 1)
        events = [(start + timedelta(hours=5 * i), "view") for i in range(60)]
        events = spark.createDataFrame(events, "ts timestamp, event_type string")
        events.repartition(parts).write.parquet(f"{folder}/events.parquet")
        streamed = QUERIES["stream_documents"](spark, folder)
        assert streamed.columns == ["doc_id", "text", "url"]
        assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, docs.collect()))
        live, batch = (QUERIES[name](spark, folder).collect() for name in ("live_throughput", "batch_throughput"))
        assert len(live) > 9 and sorted(map(tuple, live)) == sorted(map(tuple, batch))


def test_streamed_step_logs_equal_the_table_over_files_restarts_and_disorder(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [
        (run, step, start + timedelta(milliseconds=1700 * step + step % 3), rng.choice([None, 0.0, rng.random()]))
        for run, length in ((1, 90), (2, 41), (None, 5), (3, 1))
        for step in range(length)
    ]
    schema = "run long, step long, ts timestamp, loss double"
    incoming, out = new_folder(spark, "log"), new_folder(spark, "live")
    parts = [rows[k::3] for k in range(3)]
    rng.shuffle(parts[1])

    def arrive(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(incoming)
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(incoming)
        return steps.run_follow_steps(spark, log, out, 100, decay=0.5)

    assert arrive(parts[0]).count() == 2
    arrive(parts[1] + parts[0][:20])
    found = {(r.run, r.step): r for r in arrive(parts[2]).collect()}
    assert len(found) == len(rows) == spark.read.parquet(f"{out}/steps").count()

    log = spark.createDataFrame(rows, schema)
    rates = {(r.run, r.step): r for r in log_ops.step_throughput(log.filter("run IS NOT NULL"), 100).collect()}
    bests = {(r.run, r.step): r for r in log_ops.best_so_far(log.filter("run IS NOT NULL")).collect()}
    smooth = {(r.run, r.step): r for r in log_ops.smooth_loss(log.filter("run IS NOT NULL"), decay=0.5).collect()}
    for run, step, ts, loss in rows:
        got = found[run, step]
        assert (got.ts, got.loss) == (ts, loss)
        if run is not None:
            want = rates[run, step]
            assert (got.step_s, got.tokens_per_s) == (want.step_s, want.tokens_per_s)
            assert (got.best, got.improved) == (bests[run, step].best, bests[run, step].improved)
            assert abs(got.loss_smooth - smooth[run, step].loss_smooth) < 1e-12


def test_streamed_step_log_without_rows(spark):
    schema = "run string, step int, ts timestamp, loss float, extra int"
    folder = new_folder(spark, "log")
    spark.createDataFrame([("a", None, None, 1.0, 1)], schema).write.parquet(folder)
    log = spark.readStream.schema(schema).parquet(folder)
    assert steps.run_follow_steps(spark, log, new_folder(spark, "live"), 100).count() == 0
