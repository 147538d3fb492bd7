"""Vector codes against trying every entry, and the pivots' bounds."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = [[math.floor(1024 * float(np.float32(c))) for c in v] for _, v, _ in kept]
    width = len(x[0]) // parts if x else 0
    cut = [[v[p * width : p * width + width] for p in range(parts)] for v in x]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for v in cut:
                members.setdefault(near(v[p], books[p])[1], []).append(v[p])
            for k, own in members.items():
                books[p][k] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    coded = []
    for (vec_id, _, label), v in zip(kept, cut, strict=True):
        found = [near(v[p], books[p]) for p in range(parts)]
        coded.append((vec_id, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    by_label = {}
    for _, label, _, error in coded:
        by_label[label] = by_label.get(label, 0) + error
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return [(*row, by_label[row[1]]) for row in coded], hashlib.sha256(text.encode()).hexdigest()


def result(df, **options):
    codec = vector_codes.compress(df, **options)
    rows = vector_codes.with_label_error(codec.codes).select("vec_id", "label", "code", "error", "label_error")
    return [tuple(r) for r in rows.collect()], codec.digest()


def ordered(rows):
    return sorted(rows, key=repr)


def drawn(count, width, seed=1):
    draw = random.Random(seed)
    return [[draw.gauss(0, 0.2) for _ in range(width)] for _ in range(count)]


def same(spark, rows, **options):
    found, digest = result(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    expected, expected_digest = brute(rows, **{k: v for k, v in options.items() if k != "pivots"})
    assert ordered(found) == ordered(expected)
    assert digest == expected_digest


def test_all_entries_tried(spark):
    rows = [(3 * n, v, n % 5 if n % 7 else None) for n, v in enumerate(drawn(600, 16))]
    same(spark, rows)


@pytest.mark.parametrize("pivots", [1, 3, 300])
def test_any_number_of_pivots(spark, pivots):
    rows = [(n, v, 0) for n, v in enumerate(drawn(150, 8, pivots))]
    same(spark, rows, entries=40, rounds=2, pivots=pivots)


def test_nulls_ties_and_repeats(spark):
    grid = [[(n >> k & 1) / 8 for k in range(4)] for n in range(16)]  # many equal distances
    rows = [(n, grid[n % 16], n % 3) for n in range(60)]
    rows += [(5, grid[3], None), (5, grid[3], None), (None, grid[7], 1), (None, grid[2], None)]
    rows += [(70, None, 1), (71, [0.1, None, 0.2, 0.3], 1), (72, [math.nan, 0.0, 0.0, 0.0], 1)]
    rows += [(73, [math.inf, 0.0, 0.0, 0.0], 1), (74, [-math.inf] * 4, 1), (75, [0.5] * 8, 2), (76, [], 2)]
    same(spark, rows, entries=6)
    same(spark, rows)


def test_fewer_rows_than_entries(spark):
    same(spark, [(n, v, 1) for n, v in enumerate(drawn(7, 12))])
    same(spark, [(1, [-0.0004, 0.0004, -1.5, 2.0], None)])


def test_a_third_of_all_rows_is_one_vector(spark):
    vectors = drawn(200, 8, 3)
    same(spark, [(n, vectors[0] if n % 3 == 0 else vectors[n % 200], 1) for n in range(600)], entries=16)


def test_nothing_to_keep(spark):
    empty = spark.createDataFrame([(1, None, 1), (2, [math.nan] * 4, 2)], SCHEMA)
    assert result(empty) == ([], hashlib.sha256(b"").hexdigest())
    assert result(empty.limit(0)) == ([], hashlib.sha256(b"").hexdigest())


def test_clashing_columns(spark):
    rows = [(n, v, 1) for n, v in enumerate(drawn(40, 8))]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("x", "to_pivots", "code", "error", "label_error", "of_label", "part"):
        df = df.withColumn(name, F.col("vec_id"))
    assert ordered(result(df)[0]) == ordered(brute(rows)[0])


def test_what_cannot_be_coded_says_so(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [0.1] * 6, 1)], SCHEMA))
    with pytest.raises(ValueError, match="64 bits"):
        vector_codes.compress(spark.createDataFrame([(1, [2.0e6] * 64, 1)], SCHEMA))


def test_bounds_never_change_the_nearest():
    draw = np.random.default_rng(5)
    for spread in (2, 40, 4000):
        x = draw.integers(-spread, spread, (500, 6))
        book = draw.integers(-spread, spread, (70, 6))
        pivots = vector_codes._spread_pivots(book, 5)
        found, best = vector_codes.nearest(
            x, book, vector_codes._distances(x, pivots), vector_codes._distances(book, pivots)
        )
        squares = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (found == squares.argmin(1)).all()
        assert (best == squares.min(1)).all()
