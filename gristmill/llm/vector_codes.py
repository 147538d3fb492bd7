"""Product quantisation of vectors in whole numbers, with LAESA pivots.

Vectors are scaled to integers and cut into parts; each part position has a codebook. Some
entries of the first codebooks are pivots for good: the distance of every part to every pivot of
its position is computed once and stored. In each round the distances of the entries to the
pivots give a lower bound for each part and entry, the difference of their distances to a
pivot. Entries are tried in the order of their bounds until the bound passes the nearest exact
distance found, so the result is that of trying all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.session import stage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
PIVOTS = 8
ROWS_AT_ONCE = 1024
TRIED_AT_ONCE = 32
SLACK = 1e-6  # bounds are doubles: a bound must pass the distance by more than their rounding


@dataclass(frozen=True)
class Codec:
    """``books[part][entry]`` are the components of an entry, ``codes`` the encoded rows."""

    books: np.ndarray
    codes: DataFrame

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def whole_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, x)`` with ``x`` the floors of the scaled components.

    Rows with a null vector, or a null or non-finite component, are dropped; so are those whose
    vector is not as long as that of the smallest vec_id kept, as nothing compares them.
    """
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = df.select("vec_id", "label", "embedding").filter(F.col("embedding").isNotNull() & ~bad)
    first = kept.orderBy(*_by_id()).select(F.size("embedding")).first()
    if first is not None:
        kept = kept.filter(F.size("embedding") == first[0])
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("int"))
    return kept.select("vec_id", "label", x.alias("x"))


def _by_id(vector: str = "embedding") -> list:
    """The order of vec_ids, nulls last; rows of one vec_id by their vector."""
    return [F.col("vec_id").asc_nulls_last(), F.col(vector)]


def _spread_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """``count`` entries far from each other: each next has the greatest sum of distances."""
    chosen, total = [0], np.zeros(len(entries))
    while len(chosen) < min(count, len(entries)):
        total += np.sqrt(((entries - entries[chosen[-1]]) ** 2).sum(1))
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return entries[chosen]


def _distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances of each row of ``x`` to each row of ``to``; their squares are exact."""
    squares = [((x - point) ** 2).sum(1) for point in to]
    return np.sqrt(np.stack(squares, 1).astype(np.float64))


def nearest(x: np.ndarray, book: np.ndarray, x_pivots: np.ndarray, book_pivots: np.ndarray) -> tuple:
    """Per row of ``x`` the nearest entry, the lower one of a tie, and its squared distance.

    Entries come in the order of their lower bounds, some at a time. A row is done once its next
    bound is beyond its best distance; a tie's bound never is.
    """
    bound = np.zeros((len(x), len(book)))
    for k in range(book_pivots.shape[1]):
        np.maximum(bound, np.abs(x_pivots[:, k, None] - book_pivots[None, :, k]), out=bound)
    order = np.argsort(bound, axis=1)
    best = np.full(len(x), np.iinfo(np.int64).max)
    found = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for at in range(0, len(book), TRIED_AT_ONCE):
        if at:
            next_bound = bound[rows, order[rows, at]]
            rows = rows[next_bound * (1 - SLACK) - SLACK <= np.sqrt(best[rows].astype(np.float64))]
            if not len(rows):
                break
        tried = np.sort(order[rows, at : at + TRIED_AT_ONCE], axis=1)  # so the first least is the lowest
        apart = x[rows, None, :] - book[tried]
        squares = np.einsum("ijk,ijk->ij", apart, apart)
        here = squares.argmin(1)
        square = squares[np.arange(len(rows)), here]
        entry = tried[np.arange(len(rows)), here]
        better = (square < best[rows]) | ((square == best[rows]) & (entry < found[rows]))
        best[rows[better]], found[rows[better]] = square[better], entry[better]
    return found, best


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """A batch's arrays, all of one length, as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _with_pivots(pivots: np.ndarray):
    """Add ``to_pivots``: the distances to the pivots, part by part."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, count, width = pivots.shape
        for piece in _pieces(batches):
            x = _matrix(piece["x"], np.int64).reshape(-1, parts, width)
            near = np.concatenate([_distances(x[:, p], pivots[p]) for p in range(parts)], 1)
            offsets = np.arange(0, near.size + 1, parts * count, dtype=np.int32)
            column = pa.ListArray.from_arrays(offsets, near.ravel())
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, column], [*piece.schema.names, "to_pivots"]
            )

    return add


def _assign(piece: pa.RecordBatch, books: np.ndarray, pivots: np.ndarray, to_pivots: list) -> tuple:
    """The parts of a batch, and the entries and squared distances they are assigned."""
    parts, count, width = pivots.shape
    x = _matrix(piece["x"], np.int64).reshape(-1, parts, width)
    near = _matrix(piece["to_pivots"], np.float64).reshape(-1, parts, count)
    found = [nearest(x[:, p], books[p], near[:, p], to_pivots[p]) for p in range(parts)]
    return x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _tally(books: np.ndarray, pivots: np.ndarray):
    """Per task the count and sums of each entry's parts, whatever the number of its rows."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        to_pivots = [_distances(books[p], pivots[p]) for p in range(parts)]
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)
        for piece in _pieces(batches):
            x, found, _ = _assign(piece, books, pivots, to_pivots)
            for p in range(parts):
                counts[p] += np.bincount(found[:, p], minlength=entries)
                np.add.at(sums[p], found[:, p], x[:, p])
        part, entry = np.nonzero(counts)
        if len(part):
            offsets = np.arange(0, len(part) * width + 1, max(width, 1), dtype=np.int32)[: len(part) + 1]
            if not width:
                offsets = np.zeros(len(part) + 1, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.int32()),
                    pa.array(entry, pa.int32()),
                    pa.array(counts[part, entry]),
                    pa.ListArray.from_arrays(offsets, sums[part, entry].ravel()),
                ],
                ["part", "entry", "n", "sums"],
            )

    return tally


def _encode(books: np.ndarray, pivots: np.ndarray):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_pivots = [_distances(books[p], pivots[p]) for p in range(len(books))]
        for piece in _pieces(batches):
            _, found, squares = _assign(piece, books, pivots, to_pivots)
            codes = [bytes(row).hex() for row in found.astype(np.uint8)]
            columns = [piece["vec_id"], piece["label"], pa.array(codes, pa.string()), pa.array(squares.sum(1))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return encode


def _moved(vectors: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of the mean of its parts; an unused one stays."""
    width = books.shape[2]
    partial = vectors.mapInArrow(_tally(books, pivots), "part int, entry int, n long, sums array<long>")
    totals = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)]
    )
    books = books.copy()
    for row in totals.collect():  # a row per entry at most
        books[row["part"], row["entry"]] = [row[f"s{k}"] // row["n"] for k in range(width)]
    return books


def _checked(x: np.ndarray | int, width: int) -> None:
    if width * (2 * int(x)) ** 2 >= 1 << 63:
        raise ValueError(f"components up to {x} give squared distances beyond 64 bits")


def compress(
    df: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    pivots: int = PIVOTS,
) -> Codec:
    """Codebooks after ``rounds`` rounds, and ``(vec_id, label, code, error)`` per row kept.

    Every component becomes floor(scale * x), a vector ``parts`` equal parts. A position's
    codebook starts as that part of the ``entries`` smallest vec_ids (at most 256; nulls last,
    rows of one vec_id by their vector); fewer rows give fewer entries, equal entries stay apart
    and the lower one wins. ``error`` sums the squared distances of the parts.

    See ``whole_vectors`` for the rows that are dropped. Repeated rows are kept each. A table
    without a row to keep gives no row and no entry. A length that ``parts`` does not divide, or
    components too large for 64-bit squared distances, raise an error. Of the columns only
    ``vec_id``, ``embedding`` and ``label`` are read.

    Codebooks and pivots are a few hundred short vectors whatever the table's size; a round
    returns at most as many sums, added up within tasks and then by Spark.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part")
    kinds = dict(df.dtypes)
    whole = whole_vectors(df, scale)
    first = [row["x"] for row in whole.orderBy(*_by_id("x")).limit(entries).collect()]
    codes = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if not first:
        return Codec(np.zeros((parts, 0, 0), np.int64), df.sparkSession.createDataFrame([], codes))
    if len(first[0]) % parts:
        raise ValueError(f"{len(first[0])} components cannot be cut into {parts} equal parts")
    width = len(first[0]) // parts
    books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    fixed = np.stack([_spread_pivots(book, pivots) for book in books])
    vectors = whole.mapInArrow(
        _with_pivots(fixed),
        f"vec_id {kinds['vec_id']}, label {kinds['label']}, x array<int>, to_pivots array<double>",
    )
    vectors = stage(vectors, "vectors")
    most = vectors.agg(F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()[0]
    _checked(most or 0, width)
    for _ in range(rounds):
        books = _moved(vectors, books, fixed)
    return Codec(books, vectors.mapInArrow(_encode(books, fixed), codes))


def with_label_error(codes: DataFrame) -> DataFrame:
    """Add ``label_error``: the errors of equal labels added up, nulls together.

    A label that a third of all rows share is added up within tasks first, and its sum is
    joined back, where adaptive execution splits it.
    """
    codes = stage(codes, "codes")
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = stage(totals, "label-errors").withColumnRenamed("label", "of_label")
    same = F.col("label").eqNullSafe(F.col("of_label"))
    return codes.join(totals, same).drop("of_label")
