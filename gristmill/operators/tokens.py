"""Text pieces, a corpus-built vocabulary, and token ids."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.operators.chats import END_OF_TEXT

# Fixed value: the published GPT-2 split pattern, with Unicode classes switched on.
PIECE_PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

VOCAB_SIZE = 50_257
MAX_VOCAB_SIZE = 65_536  # ids are stored as unsigned 16-bit
BYTE_IDS = 256
PIECES_AT_ONCE = 65_536


def pieces(text: Column) -> Column:
    """Array of pieces whose concatenation is the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE_PATTERN), F.lit(0))


def pretokenize(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, pieces(F.col(text)).alias("pieces"))


def piece_counts(pretokenized: DataFrame) -> DataFrame:
    """Pieces and their counts, summed in each task before the shuffle.

    The outer form keeps Spark from adding a filter that would match the pattern twice.
    """
    spread = pretokenized.select(F.explode_outer("pieces").alias("piece"))
    return spread.filter(F.col("piece").isNotNull()).groupBy("piece").count()


@dataclass(frozen=True)
class Vocabulary:
    """Ids: 256 bytes, then the pieces, then end-of-text as the last one."""

    pieces: tuple[str, ...]

    @property
    def eot(self) -> int:
        return BYTE_IDS + len(self.pieces)

    @property
    def size(self) -> int:
        return self.eot + 1


def build_vocab(pretokenized: DataFrame, size: int = VOCAB_SIZE) -> DataFrame:
    """``(token, piece, count)`` of the most frequent pieces, ties in piece order."""
    if not BYTE_IDS + 1 < size <= MAX_VOCAB_SIZE:
        raise ValueError(f"vocabulary size must lie in 258..{MAX_VOCAB_SIZE}")
    most = size - BYTE_IDS - 1
    order = [F.desc("count"), F.asc("piece")]
    top = piece_counts(pretokenized).orderBy(*order).limit(most)
    # At most 65,279 rows are left here, so one partition can number them.
    number = F.row_number().over(Window.orderBy(*order))
    return top.select((number + (BYTE_IDS - 1)).alias("token"), "piece", "count")


def load_vocab(vocab: DataFrame) -> Vocabulary:
    """Bring a built vocabulary (bounded by 16-bit ids) to the driver."""
    rows = vocab.orderBy("token").select("piece").collect()
    return Vocabulary(tuple(row["piece"] for row in rows))


def encoder(vocab: Vocabulary):
    """Column function: array of pieces to array of ids; a null piece is end-of-text.

    Works on Arrow batches, ``PIECES_AT_ONCE`` pieces at a time, however many documents they
    belong to, so that what is needed besides the batch does not grow with it. Unknown pieces
    become their UTF-8 byte ids.
    """
    known, eot = vocab.pieces, vocab.eot

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pa.array(known, pa.string())

        def spell(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """Ids of some pieces, and where each piece begins and the last one ends in them."""
            ids = pc.add(pc.index_in(flat, value_set=table, skip_nulls=True), 256)
            ids = pc.if_else(flat.is_null(), pa.scalar(eot, pa.int32()), ids)
            unknown = ids.is_null().to_numpy(zero_copy_only=False)
            spelled = flat.filter(pa.array(unknown)).cast(pa.binary())
            lengths = pc.binary_length(spelled).to_numpy(zero_copy_only=False)

            widths = np.ones(len(flat), np.int64)
            widths[unknown] = lengths
            ends = np.concatenate([[0], np.cumsum(widths)])
            out = np.empty(ends[-1], np.int32)
            out[ends[:-1][~unknown]] = ids.drop_null().to_numpy(zero_copy_only=False)
            if len(spelled):
                content = b"".join(spelled.to_pylist())
                firsts = np.repeat(ends[:-1][unknown] - (np.cumsum(lengths) - lengths), lengths)
                out[firsts + np.arange(len(content))] = np.frombuffer(content, np.uint8)
            return out, ends

        for rows in batches:
            flat = rows.flatten().cast(pa.string())
            sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            borders = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            offsets, parts, done = np.zeros(len(borders), np.int64), [], 0
            for low in range(0, len(flat), PIECES_AT_ONCE):
                out, ends = spell(flat.slice(low, PIECES_AT_ONCE))
                # A border behind the last piece of a part is set here, and again by the next part.
                here = slice(*np.searchsorted(borders, (low, low + len(ends))))
                offsets[here] = done + ends[borders[here] - low]
                parts.append(out)
                done += len(out)
            ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))

    return encode


def encode_documents(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Replace ``text`` by ``tokens`` (end-of-text appended) and ``n_tokens``, without a shuffle.

    A marker inside a document is ordinary text.
    """
    closed = F.concat(pieces(F.col("text")), F.array(F.lit(None).cast("string")))
    encoded = docs.withColumn("tokens", encoder(vocab)(closed)).drop("text")
    return encoded.withColumn("n_tokens", F.size("tokens").cast("long"))


def encode_samples(parts: DataFrame, vocab: Vocabulary, text: str = "part") -> DataFrame:
    """Replace ``text`` by ``tokens`` and ``n_tokens``; each marker becomes the end-of-text id.

    Works on the parts of a chat: a part ends in one line break and the next begins with a
    mark, where the split pattern cuts anyway, so parts and whole samples give the same ids.
    """
    segments = F.split(F.col(text), re.escape(END_OF_TEXT))
    marked = F.transform(
        segments,
        lambda segment, i: F.when(i == 0, pieces(segment)).otherwise(
            F.concat(F.array(F.lit(None).cast("string")), pieces(segment))
        ),
    )
    encoded = parts.withColumn("tokens", encoder(vocab)(F.flatten(marked))).drop(text)
    return encoded.withColumn("n_tokens", F.size("tokens").cast("long"))


def decoder(vocab: Vocabulary):
    """Column function: array of ids to the bytes they stand for, on whole Arrow batches."""
    spelled = [bytes([i]) for i in range(BYTE_IDS)]
    spelled += [piece.encode() for piece in vocab.pieces]
    spelled.append(END_OF_TEXT.encode())

    @F.arrow_udf(T.BinaryType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pa.array(spelled, pa.binary())
        for rows in batches:
            sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            parts = table.take(rows.flatten())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)
            yield pc.binary_join(lists, pa.scalar(b"", pa.binary()))

    return decode


def decode_tokens(
    encoded: DataFrame, vocab: Vocabulary, key: str = "doc_id", first: int | None = None
) -> DataFrame:
    """Text of each row's ids, or of its ``first`` ones.

    A cut inside a character leaves broken bytes, shown as replacement characters.
    """
    ids = F.col("tokens") if first is None else F.slice("tokens", 1, first)
    text = F.make_valid_utf8(decoder(vocab)(ids).cast("string"))
    return encoded.select(key, text.alias("text"))
