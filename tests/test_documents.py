"""Filters, budgets, shards and splits on small hand-made tables."""

from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import filters, shards, splits
from gristmill.operators.ordered import Buckets, cutoff, running
from gristmill.session import new_folder
from gristmill.sources import raw_shards, tables


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(column, spark):
    return spark.range(1).select(column).first()[0]


def test_length_bounds(spark):
    docs = documents(spark, ["x" * 199, "x" * 200, "x" * 100_000, "x" * 100_001, None, ""])
    assert [r.doc_id for r in filters.filter_length(docs).orderBy("doc_id").collect()] == [1, 2]
    assert tuple(filters.filter_counts(docs).first()) == (2, 3, 1)


def test_length_counts_code_points(spark):
    assert one(text.char_count(F.lit("\U0001f600\U0001f601")), spark) == 2


def test_stored_length_reaches_the_scan(spark):
    path = new_folder(spark, "pushed")
    documents(spark, ["a" * 300]).withColumn("n_chars", F.length("text")).write.parquet(path)
    kept = filters.filter_length(spark.read.parquet(path), chars=F.col("n_chars"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n_chars,200)" in plan


def test_tiny(spark):
    docs = documents(spark, ["x" * 9, "x" * 10])
    assert [r.doc_id for r in filters.drop_tiny(docs).collect()] == [1]


def test_white_space_is_pythons(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    assert len(spaces) == 29
    samples = [f"{s}a{s}{s}b c{s}" for s in spaces] + ["", "   ", "a", "​a﻿ b"]
    rows = documents(spark, samples).select(
        "doc_id", text.word_count(F.col("text")).alias("n"), text.strip(F.col("text")).alias("s")
    )
    for row in rows.collect():
        assert row.n == len(samples[row.doc_id].split())
        assert row.s == samples[row.doc_id].strip()


def test_budget_keeps_the_crossing_row(spark):
    docs = documents(spark, ["a b", "a b c", "a", "a b c d"])
    assert filters.take_until_budget(docs, 5, 1.0).count() == 2
    assert filters.take_until_budget(docs, 4, 1.0).count() == 2
    assert filters.take_until_budget(docs, 6, 1.0).count() == 3
    assert filters.take_until_budget(docs, 99, 1.0).count() == 4


def test_size_estimate_divides_by_rows_seen(spark):
    docs = documents(spark, ["a b", "a b c d"])
    row = filters.size_estimate(docs, 3, 100, 10, 1.0).first()
    assert (row.mean_tokens, row.docs_needed, row.shards_needed) == (3.0, 33, 4)


def test_running_matches_a_plain_loop(spark):
    keys = [(i * 7919) % 1000 - 500 + (10**12 if i % 3 else 0) for i in range(600)]
    rows = [(k, f"g{k % 2}" if k % 5 else "hot", abs(k) % 13) for k in set(keys)]
    df = spark.createDataFrame(rows, "k long, g string, w long")
    expected = {}
    for group in {g for _, g, _ in rows}:
        total, least = 0, None
        for at, (k, _, w) in enumerate(sorted(r for r in rows if r[1] == group), 1):
            expected[k] = (at, total, least)
            total, least = total + w, w if least is None else min(least, w)
    for count in (2, 5, 64):
        buckets = Buckets.of(df, F.col("k"), count)
        found = running(
            df.repartition(count), ["k"], buckets, {"s": ("sum", "w"), "m": ("min", "w")}, ["g"]
        )
        assert {r.k: (r["rank"], r.s, r.m) for r in found.collect()} == expected


def test_cutoff_matches_a_plain_loop(spark):
    rows = [(i * 3 + (2**60 if i > 40 else 0), i % 7) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, w long")
    buckets = Buckets.of(df, F.col("k"), 6)
    for target in (1, 6, 50, 111, sum(w for _, w in rows), 10_000):
        total, expected = 0, None
        for k, w in rows:
            total += w
            if total >= target:
                expected = (k,)
                break
        assert cutoff(df, ["k"], buckets, F.col("w"), target) == expected


def test_shards_fill_exactly(spark):
    docs = documents(spark, ["x"] * 20)
    counted = shards.shard_by_rows(docs, 10).groupBy("shard").count().orderBy("shard").collect()
    assert [tuple(r) for r in counted] == [(0, 10), (1, 10)]


def test_shards_with_clumped_keys(spark):
    keys = sorted([i for i in range(300)] + [2**61 + i for i in range(303)])
    docs = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    found = {r.doc_id: r.shard for r in shards.shard_by_rows(docs, 50).collect()}
    assert found == {k: at // 50 for at, k in enumerate(keys)}


def test_resume_numbers_on_and_takes_nothing_twice(spark):
    docs = documents(spark, ["x"] * 25)
    written = shards.shard_by_rows(docs.filter("doc_id % 2 = 0"), 10)
    rest = shards.resume_ingest(docs, written, 10).collect()
    assert {r.doc_id for r in rest} == {i for i in range(25) if i % 2}
    assert sorted({r.shard for r in rest}) == [2, 3]
    assert shards.next_shard(written.limit(0)) == 0


def test_split_by_shard(spark):
    def val(n, share=0.02):
        df = spark.createDataFrame([(i,) for i in range(n)], "shard long")
        marked = splits.split_by_shard(df, share).filter("split = 'val'")
        return sorted(r.shard for r in marked.collect())

    assert val(1) == [0]
    assert val(10) == [9]
    assert val(100) == [98, 99]
    assert val(10, 0.35) == [7, 8, 9]


def test_shuffle_ignores_partitioning(spark):
    ids = spark.range(500).withColumnRenamed("id", "conv_id")
    orders = [
        {r.conv_id: r.position for r in splits.seeded_shuffle(ids.repartition(n)).collect()}
        for n in (1, 7)
    ]
    assert orders[0] == orders[1]
    assert sorted(orders[0].values()) == list(range(500))
    other = {r.conv_id: r.position for r in splits.seeded_shuffle(ids, seed=1).collect()}
    assert other != orders[0]


def test_split_head_sizes(spark):
    for n, sizes in ((400, {"val": 400}), (600, {"val": 500, "train": 100})):
        ids = spark.range(n).withColumnRenamed("id", "conv_id")
        counted = splits.split_head(ids).groupBy("split").count().collect()
        assert {r["split"]: r["count"] for r in counted} == sizes


def test_defaults_fill_absent_columns_only(spark):
    df = spark.createDataFrame([(1, "t", None)], "doc_id long, text string, url string")
    row = tables.scan_documents(df).first()
    assert (row.url, row.score) == (None, 0.0)


def test_raw_shards_round_trip(spark):
    docs = documents(spark, [f"text {i}" for i in range(25)])
    path = new_folder(spark, "raw")
    raw_shards.write_raw_shards(shards.shard_by_rows(docs, 10), path)
    back = raw_shards.read_raw_shards(spark, path)
    assert {(r.doc_id, r.shard, r.n_chars) for r in back.collect()} == {
        (i, i // 10, len(f"text {i}")) for i in range(25)
    }
    files = raw_shards.raw_shard_files(spark, path)
    assert sorted(r.shard for r in files.collect()) == [0, 1, 2]

    counted = shards.shard_manifest(
        filters.measure(back).join(back.select("doc_id", "shard"), "doc_id")
    )
    manifest = raw_shards.file_manifest(counted, files)
    raw_shards.write_json_report(manifest, f"{path}-manifest")
    stored = raw_shards.read_manifest(spark, f"{path}-manifest")
    assert [r.shard for r in stored.collect()] == [0, 1, 2]
    assert raw_shards.verify_checksums(stored, files, ["shard"]).filter("NOT match").count() == 0
    gone = raw_shards.verify_checksums(stored, files.filter("shard <> 2"), ["shard"])
    assert [r.shard for r in gone.filter("NOT present").collect()] == [2]
    spoiled = stored.withColumn("md5", F.when(F.col("shard") == 1, "0").otherwise(F.col("md5")))
    assert [r.shard for r in raw_shards.verify_checksums(spoiled, files, ["shard"]).filter("NOT match").collect()] == [1]


def test_manifest_as_one_array(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(
        '[\n {"shard": 1, "num_rows": 5},\n {"shard": 0, "num_rows": 7}\n]'
    )
    found = raw_shards.read_manifest(spark, str(tmp_path), one_array=True)
    assert [(r.shard, r.num_rows) for r in found.collect()] == [(0, 7), (1, 5)]


def test_missing_and_present(spark):
    manifest = spark.createDataFrame([(i, i) for i in range(4)], "shard long, num_rows long")
    listing = spark.createDataFrame([(1,), (3,)], "shard long")
    assert {r.shard for r in shards.missing_shards(manifest, listing).collect()} == {0, 2}
    assert {r.shard for r in shards.present_shards(manifest, listing).collect()} == {1, 3}
