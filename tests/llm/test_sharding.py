"""Shards hold every row once, in equal numbers and random order."""

import zlib
from collections import Counter

import pytest

from gristmill.llm import sharding
from gristmill.session import new_folder


def corpus(n):
    return [(i, f"text {i} " * (i % 9)) for i in range(n)]


def place(docs, **options):
    return sharding.shard_rows(docs, **options).collect()


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 300}, {"shards": 7, "bucket_bytes": 1000}])
def test_every_row_once_in_equal_shards(spark, documents, options):
    rows = corpus(503)
    found = place(documents(rows), **options)
    shards = options.get("shards", 40)
    texts = dict(rows)
    assert sorted(r.doc_id for r in found) == sorted(texts)
    counts = Counter(r.shard for r in found)
    assert set(counts) <= set(range(shards))
    assert max(counts.values()) - min(counts.get(k, 0) for k in range(shards)) <= 1
    for k, n in counts.items():
        assert sorted(r.slot for r in found if r.shard == k) == list(range(n))
    for r in found:
        assert r.size == len(texts[r.doc_id].encode()) + 16
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert (r.law, r.grown_shard) == ("rows", None)


def test_the_order_is_a_shuffle(spark, documents):
    found = place(documents(corpus(2000)), shards=4, bucket_bytes=4000)
    order = [r.doc_id for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    rising = sum(a < b for a, b in zip(order, order[1:]))
    assert 900 < rising < 1100
    mean = {k: sum(r.doc_id for r in found if r.shard == k) / 500 for k in range(4)}
    assert all(850 < m < 1150 for m in mean.values())


def test_shards_hold_whole_rows(spark, documents):
    docs = documents([(i, t, "en", "s") for i, t in corpus(50)], clash=("shard", "slot", "doc", "bucket", "all"))
    path = new_folder(spark, "shards")
    sharding.shuffle_into_shards(docs, path, shards=3)
    back = sharding.read_shards(spark, path, docs).select("doc.*")
    assert back.columns == docs.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))


def test_nulls_repeated_and_long_rows(spark, documents):
    rows = [(None, None), (None, None), (1, None), (2, ""), (3, "same"), (3, "same"), (4, "é" * 200_000)]
    found = place(documents(rows))
    assert Counter((r.doc_id, r.size) for r in found) == Counter(
        (i, len((t or "").encode()) + 16) for i, t in rows
    )
    assert {r.text_crc32 for r in found if r.size == 16} == {0}


def test_fewer_rows_than_shards_and_none(spark, documents):
    found = place(documents(corpus(5)))
    assert len({r.shard for r in found}) == 5 and {r.slot for r in found} == {0}
    assert place(documents([])) == []
    assert sharding.shard_rows(documents([])).columns == sharding.shard_rows(documents(corpus(2))).columns


def test_a_hot_text_is_spread(spark, documents):
    docs = documents([(i, "the same copy") for i in range(600)])
    slot = sharding._slot(sharding.SEED, 16)
    sizes = [r["count"] for r in docs.groupBy(slot.alias("slot")).count().collect()]
    assert max(sizes) < 3 * 600 / 16


def test_many_repeats_of_one_row_are_dealt_over_all_buckets(spark, documents):
    rows = [(7, "x" * 184)] * 3000 + [(None, "y" * 184)] * 1000 + corpus(500)
    docs = documents(rows)
    options = {"bucket_bytes": 20_000, "slots": 1 << 12}
    records, counted = sharding.slotted(docs, **options)
    sizes = [r.bytes for r in counted.collect()]
    assert sum(sizes) == sum(len(t) + 16 for _, t in rows)
    assert max(sizes) < 4000
    assert records.count() == 4500
    found = place(docs, **options)
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, len(t) + 16) for i, t in rows)
    counts = Counter(r.shard for r in found)
    assert set(counts) == set(range(40)) and set(counts.values()) <= {112, 113}
    for k, n in counts.items():
        assert sorted(r.slot for r in found if r.shard == k) == list(range(n))
