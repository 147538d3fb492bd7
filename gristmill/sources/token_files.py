"""Token shard files: a 256-int header, then little-endian unsigned 16-bit ids.

``token_files`` is a Spark data source. A writer task appends the rows of its shards to
files under a task-own name, hashing and counting as it goes; the commit gives complete files
their final names, so a lost or repeated task leaves no half-written shard, and then writes
what the tasks counted as one manifest. The reader cuts a shard into ranges of ids; bounds of
split, shard and start, or a list of ranges, decide which of them are read at all. They are
options of a read, not filters that Spark pushes down: the scans of one loaded DataFrame share
what was pushed last, so two different filters on it would read the same rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from gristmill.operators.quality import HEADER_INTS, MAGIC, TOKEN_BYTES, VERSION

HEADER_BYTES = HEADER_INTS * 4
TASK_IDS = 64_000_000
FILE_IDS = 1_000_000  # what opening a file counts as, when small ones are grouped
FILES_AT_ONCE = 32
ROW_IDS = 1_000_000
HEADER_FIELDS = ("split", "shard", "magic", "version", "tokens", "vocab_size", "payload_bytes")
NAME = re.compile(r"([a-z]+)_(\d+)\.bin$")
SCHEMA = "split string, shard long, start long, tokens array<int>"
MANIFEST = "manifest.json"
MANIFEST_SCHEMA = "split string, shard long, file string, docs long, tokens long, bytes long, md5 string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a URI, as Spark accepts them (``file:/x`` too)."""
    if re.match(r"file:/(?!/)", path):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _runs(splits: list, shards: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of neighbouring rows of one shard."""
    if not splits:
        return []
    names = np.array(splits)
    new = np.flatnonzero((shards[1:] != shards[:-1]) | (names[1:] != names[:-1])) + 1
    borders = [0, *new.tolist(), len(splits)]
    return list(zip(borders[:-1], borders[1:], strict=True))


def _each(action, items: list) -> None:
    """File operations of the driver, many at a time."""
    with ThreadPoolExecutor(FILES_AT_ONCE) as pool:
        list(pool.map(action, items))


class Written(WriterCommitMessage):
    """The finished parts of a task, and the manifest entry of each."""

    def __init__(self, parts: list[str], entries: list[dict]):
        self.parts, self.entries = parts, entries


class ShardSink:
    """A file of one shard that counts and hashes what goes into it."""

    def __init__(self, files: fs.FileSystem, part: str, split: str, shard: int, expected: int):
        self.part, self.expected = part, expected
        self.sink, self.digest = files.open_output_stream(part), hashlib.md5()
        self.entry = {
            "split": split, "shard": shard, "file": f"{split}_{shard:05d}.bin", "docs": 0, "tokens": 0, "bytes": 0
        }

    def put(self, data: bytes, docs: int = 0, tokens: int = 0) -> None:
        self.sink.write(data)
        self.digest.update(data)
        self.entry["docs"] += docs
        self.entry["tokens"] += tokens
        self.entry["bytes"] += len(data)

    def close(self) -> dict:
        self.sink.close()
        if self.entry["tokens"] != self.expected:
            raise ValueError(f"{self.entry['file']}: {self.entry['tokens']} ids, {self.expected} expected")
        return self.entry | {"md5": self.digest.hexdigest()}


class TokenFileWriter(DataSourceArrowWriter):
    """Rows arrive by shard and in order within it: see ``export_token_shards``."""

    def __init__(self, path: str, vocab_size: int, header: bool):
        self.path, self.vocab_size, self.header = path, vocab_size, header

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open(self.path)
        attempt = TaskContext.get().taskAttemptId()
        parts, entries, sink = [], [], None
        files.create_dir(f"{root}/_parts", recursive=True)
        for batch in iterator:
            splits, shards = batch["split"].to_pylist(), batch["shard"].to_numpy()
            starts, totals = batch["start"].to_numpy(), batch["shard_tokens"].to_numpy()
            offsets = batch["tokens"].offsets.to_numpy()
            flat = batch["tokens"].values.to_numpy(zero_copy_only=False)
            for low, high in _runs(splits, shards):
                shard = (splits[low], int(shards[low]))
                if sink is None or shard != (sink.entry["split"], sink.entry["shard"]):
                    if sink is not None:
                        entries.append(sink.close())
                    part = f"{root}/_parts/{shard[0]}_{shard[1]:05d}.{attempt}"
                    sink = ShardSink(files, part, *shard, int(totals[low]))
                    parts.append(part)
                    if self.header:
                        header = np.zeros(HEADER_INTS, "<i4")
                        header[:4] = MAGIC, VERSION, sink.expected, self.vocab_size
                        sink.put(header.tobytes())
                places = offsets[low : high + 1]
                if (starts[low:high] != sink.entry["tokens"] + places[:-1] - places[0]).any():
                    raise ValueError(f"shard {shard}: rows out of order at id {sink.entry['tokens']}")
                tokens = flat[places[0] : places[-1]]
                if len(tokens) and not 0 <= tokens.min() <= tokens.max() < 65_536:
                    raise ValueError(f"shard {shard}: an id does not fit 16 bits")
                sink.put(tokens.astype("<u2").tobytes(), high - low, len(tokens))
        if sink is not None:
            entries.append(sink.close())
        return Written(parts, entries)

    def commit(self, messages: list[Written | None]) -> None:
        """Names of complete files, then the manifest; parts of lost attempts go with their folder.

        The manifest is one file that appears whole. Shards that an earlier write to the same
        path has left stay listed, unless they were written again.
        """
        files, root = _open(self.path)
        done = [m for m in messages if m is not None]
        entries = {(e["split"], e["shard"]): e for e in _entries(files, root)}
        entries |= {(e["split"], e["shard"]): e for m in done for e in m.entries}
        moves = [(part, f"{root}/{e['file']}") for m in done for part, e in zip(m.parts, m.entries, strict=True)]
        _each(lambda pair: files.move(*pair), moves)
        if entries:
            with files.open_output_stream(f"{root}/_parts/{MANIFEST}") as sink:
                for key in sorted(entries):
                    sink.write(json.dumps(entries[key]).encode() + b"\n")
            files.move(f"{root}/_parts/{MANIFEST}", f"{root}/{MANIFEST}")
        if files.get_file_info(f"{root}/_parts").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/_parts")

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _open(self.path)
        _each(files.delete_file, [part for m in filter(None, messages) for part in m.parts])


def _entries(files: fs.FileSystem, root: str) -> list[dict]:
    if files.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    with files.open_input_stream(f"{root}/{MANIFEST}") as source:
        return [json.loads(line) for line in source.read().splitlines()]


@dataclass(frozen=True)
class IdRange:
    path: str
    split: str
    shard: int
    offset: int
    start: int
    count: int


class IdRanges(InputPartition):
    def __init__(self, ranges: list[IdRange]):
        super().__init__(None)
        self.ranges = ranges


@dataclass(frozen=True)
class Wanted:
    """What is read: one split or all, shards from one to another, ids from ``start`` on."""

    split: str | None = None
    first_shard: int = 0
    last_shard: int | None = None
    start: int = 0

    def file(self, split: str, shard: int) -> bool:
        return self.split in (None, split) and self.first_shard <= shard <= (shard if self.last_shard is None else self.last_shard)


class TokenFileReader(DataSourceReader):
    """Rows of ``row_ids`` ids, or the ``ranges`` alone: ``{(split, shard): [(start, count)]}``.

    Rows begin at multiples of ``row_ids`` wherever a task begins, the first one at ``start``.
    """

    def __init__(self, path: str, header: bool, row_ids: int = ROW_IDS, wanted: Wanted = Wanted(), ranges: dict | None = None):
        self.path, self.header, self.row_ids, self.wanted, self.ranges = path, header, row_ids, wanted, ranges

    def _ranges(self, split: str, shard: int, ids: int) -> list[tuple[int, int]]:
        """``(start, count)`` of the ids of one file that are wanted."""
        if self.ranges is not None:
            found = self.ranges.get((split, shard), [])
            if any(start + count > ids for start, count in found):
                raise ValueError(f"{split} {shard}: a range ends behind the {ids} ids of the file")
            return found
        if not self.wanted.file(split, shard) or self.wanted.start >= max(ids, 1):
            return []
        step = max(1, TASK_IDS // self.row_ids) * self.row_ids
        cuts = [self.wanted.start, *range((self.wanted.start // self.row_ids + 1) * self.row_ids, ids, step), ids]
        return [(start, end - start) for start, end in zip(cuts[:-1], cuts[1:], strict=True)] if ids else [(0, 0)]

    def partitions(self) -> list[IdRanges]:
        """Large files are cut into ranges, small ones share a task."""
        files, root = _open(self.path)
        tasks, room = [], 0
        for info in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda info: info.path):
            named = NAME.search(info.path)
            if not named:
                continue
            split, shard = named.group(1), int(named.group(2))
            offset = HEADER_BYTES if self.header else 0
            ids = max(0, info.size - offset) // TOKEN_BYTES
            for start, count in self._ranges(split, shard, ids):
                if room < count:
                    tasks.append([])
                    room = TASK_IDS
                place = offset + start * TOKEN_BYTES
                tasks[-1].append(IdRange(info.path, split, shard, place, start, count))
                room -= count + FILE_IDS
        return [IdRanges(ranges) for ranges in tasks] or [IdRanges([])]

    def read(self, task: IdRanges) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.path)
        for part in task.ranges:
            with files.open_input_file(part.path) as source:
                if part.count:
                    source.seek(part.offset)
                for done in range(0, max(part.count, 1), self.row_ids):
                    wanted = min(self.row_ids, part.count - done)
                    ids = np.frombuffer(source.read(wanted * TOKEN_BYTES), "<u2")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part.split]),
                            pa.array([part.shard], pa.int64()),
                            pa.array([part.start + done], pa.int64()),
                            pa.array([ids.astype(np.int32)], pa.list_(pa.int32())),
                        ],
                        ["split", "shard", "start", "tokens"],
                    )


class TokenFiles(DataSource):
    """``path``; ``vocab_size`` for writing; ``header`` false for files of ids alone.

    For reading also ``row_ids``, the ids of a row, ``wanted``, the fields of ``Wanted`` as JSON,
    and ``ranges``, a JSON list of ``[split, shard, start, count]`` that become a row each.
    """

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def _header(self) -> bool:
        return self.options.get("header", "true").lower() == "true"

    def reader(self, schema) -> TokenFileReader:
        ranges = None
        if "ranges" in self.options:
            ranges = {}
            for split, shard, start, count in json.loads(self.options["ranges"]):
                ranges.setdefault((split, shard), []).append((start, count))
        row_ids = int(self.options.get("row_ids", str(ROW_IDS)))
        wanted = Wanted(**json.loads(self.options.get("wanted", "{}")))
        return TokenFileReader(self.options["path"], self._header(), row_ids, wanted, ranges)

    def writer(self, schema, overwrite: bool) -> TokenFileWriter:
        size = int(self.options.get("vocab_size", "0"))
        return TokenFileWriter(self.options["path"], size, self._header())


def export_token_shards(
    stream: DataFrame, path: str, vocab_size: int, header: bool = True
) -> DataFrame:
    """Write one file per (split, shard) and return the manifest with the files' checksums.

    The window brings each shard to one task in order of ``start``, without a shuffle if the
    stream is by shard already; the writer checks the order and holds no shard whole.
    """
    spark = stream.sparkSession
    spark.dataSource.register(TokenFiles)
    whole = (
        Window.partitionBy("split", "shard")
        .orderBy("start")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    (
        stream.withColumn("shard_tokens", F.sum("n_tokens").over(whole))
        .select("split", "shard", "start", "tokens", "shard_tokens")
        .write.format("token_files")
        .option("path", path)
        .option("vocab_size", vocab_size)
        .option("header", str(header).lower())
        .mode("append")
        .save()
    )
    return token_file_manifest(spark, path)


def import_token_shards(
    spark: SparkSession,
    path: str,
    header: bool = True,
    row_ids: int = ROW_IDS,
    wanted: Wanted = Wanted(),
    ranges: list | None = None,
) -> DataFrame:
    """``(split, shard, start, n_tokens, tokens)``, up to ``row_ids`` ids per row.

    Files and ids that are not ``wanted`` are not read. With ``ranges`` of ``(split, shard,
    start, count)`` each is a row of its own, and nothing else is read.
    """
    spark.dataSource.register(TokenFiles)
    reader = (
        spark.read.format("token_files")
        .option("header", str(header).lower())
        .option("row_ids", row_ids)
        .option("wanted", json.dumps(asdict(wanted)))
    )
    if ranges is not None:
        reader = reader.option("ranges", json.dumps([list(one) for one in ranges]))
    return reader.load(path).withColumn("n_tokens", F.size("tokens").cast("long"))


def read_from(spark: SparkSession, path: str, split: str, shard: int, start: int, row_ids: int = ROW_IDS) -> DataFrame:
    """The ids of ``split`` from ``start`` of ``shard`` on; what lies before is not read."""
    opened = Wanted(split, shard, shard, start)
    later = Wanted(split, shard + 1)
    rows = [import_token_shards(spark, path, row_ids=row_ids, wanted=wanted) for wanted in (opened, later)]
    return rows[0].unionByName(rows[1])


def read_windows(spark: SparkSession, path: str, windows: DataFrame, size: int) -> DataFrame:
    """``windows`` (``split, shard, first`` and others) with ``ids``: ``size + 1`` ids from ``first``.

    Windows are those of one evaluation, a few hundred, so their places fit into the plan; a
    window is one seek and one short read.
    """
    places = windows.select("split", "shard", "first").distinct().collect()
    ranges = [(row["split"], row["shard"], row["first"], size + 1) for row in places]
    ids = import_token_shards(spark, path, ranges=ranges).select(
        "split", "shard", F.col("start").alias("first"), F.col("tokens").alias("ids")
    )
    return windows.join(ids, ["split", "shard", "first"])


def _shard_files(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.bin")
        .load(path)
        .withColumn("split", F.regexp_extract(name, NAME.pattern, 1))
        .withColumn("shard", F.regexp_extract(name, NAME.pattern, 2).cast("long"))
    )


def token_file_listing(spark: SparkSession, path: str) -> DataFrame:
    """``(split, shard, path, bytes)`` without reading the files."""
    return _shard_files(spark, path).select(
        "split", "shard", "path", F.col("length").alias("bytes")
    )


def token_file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(split, shard, file, docs, tokens, bytes, md5)`` as counted and hashed while writing."""
    return spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/{MANIFEST}")


def token_file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``(split, shard, path, bytes, md5)``; files of any size, hashed piece by piece."""
    return with_md5(token_file_listing(spark, path))


def with_md5(listing: DataFrame) -> DataFrame:
    """Add the ``md5`` of the file at ``path``, read in pieces by the tasks."""

    @F.arrow_udf("string")
    def md5(paths: pa.Array) -> pa.Array:
        found = []
        for path in paths.to_pylist():
            files, plain = _open(path)
            digest = hashlib.md5()
            with files.open_input_stream(plain) as source:
                while piece := source.read(1 << 22):
                    digest.update(piece)
            found.append(digest.hexdigest())
        return pa.array(found, pa.string())

    return listing.withColumn("md5", md5("path"))


def token_file_headers(spark: SparkSession, path: str) -> DataFrame:
    """Header fields and payload size of each file, reading no more than the header."""

    schema = pa.schema([("split", pa.string()), *[(name, pa.int64()) for name in HEADER_FIELDS[1:]]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                files, plain = _open(row["path"])
                with files.open_input_file(plain) as source:
                    found = source.read(4 * 4)
                # A file too short for its header has no fields; that is a finding.
                head = np.frombuffer(found[: len(found) // 4 * 4], "<i4").tolist()
                head += [None] * (4 - len(head))
                row["magic"], row["version"], row["tokens"], row["vocab_size"] = head
                row["payload_bytes"] = row["bytes"] - HEADER_BYTES
            yield pa.RecordBatch.from_pylist(
                [{name: row[name] for name in HEADER_FIELDS} for row in rows], schema
            )

    return token_file_listing(spark, path).mapInArrow(
        read, "split string, shard long, " + ", ".join(f"{n} long" for n in HEADER_FIELDS[2:])
    )
