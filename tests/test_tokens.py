"""Pieces, vocabulary, packing, blocks and token files."""

import random
import re
import tracemalloc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from gristmill.operators import blocks, chats, packing, quality, tokens
from gristmill.plans import corpus as C
from gristmill.plans import settings as S
from gristmill.plans.queries import QUERIES
from gristmill.session import new_folder
from gristmill.sources import token_files

TEXTS = [
    "Hello  world, it's 42 o'clock!\n\n Next\tline ",
    "naïve café — 東京 \U0001f600 x",
    "the the the of of <|endoftext|> and",
    "   \n",
    "",
]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def vocab(spark):
    return tokens.load_vocab(tokens.build_vocab(tokens.pretokenize(docs(spark)), 270))


def test_pieces_match_the_published_pattern(spark):
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    for row in tokens.pretokenize(docs(spark)).collect():
        assert row.pieces == regex.findall(pattern, TEXTS[row.doc_id])
        assert "".join(row.pieces) == TEXTS[row.doc_id]


def test_vocab_order_and_bounds(spark, vocab):
    rows = tokens.build_vocab(tokens.pretokenize(docs(spark)), 270).orderBy("token").collect()
    assert [r.token for r in rows] == list(range(256, 269))
    ranks = [(-r["count"], r.piece.encode()) for r in rows]
    assert ranks == sorted(ranks)
    assert (vocab.eot, vocab.size) == (269, 270)
    with pytest.raises(ValueError):
        tokens.build_vocab(tokens.pretokenize(docs(spark)), 65_537)


def test_encode_and_decode(spark, vocab):
    encoded = tokens.encode_documents(docs(spark), vocab)
    known = {piece: 256 + i for i, piece in enumerate(vocab.pieces)}
    pieces = {r.doc_id: r.pieces for r in tokens.pretokenize(docs(spark)).collect()}
    for row in encoded.collect():
        ids = []
        for piece in pieces[row.doc_id]:
            ids += [known[piece]] if piece in known else list(piece.encode())
        assert row.tokens == [*ids, vocab.eot]
        assert row.n_tokens == len(row.tokens)
    decoded = tokens.decode_tokens(encoded, vocab).collect()
    assert {r.doc_id: r.text for r in decoded} == {
        i: f"{text}<|endoftext|>" for i, text in enumerate(TEXTS)
    }


@pytest.mark.parametrize("at_once", [1, 2, 3, 7])
def test_parts_of_a_batch_give_the_same_ids(spark, vocab, monkeypatch, at_once):
    whole = {r.doc_id: r.tokens for r in tokens.encode_documents(docs(spark).coalesce(1), vocab).collect()}
    lists = spark.createDataFrame(
        [(0, []), (1, None), (2, ["the", None, "zzé", ""]), (3, []), (4, [None]), (5, None)], "i int, pieces array<string>"
    ).coalesce(1)
    expected = {r.i: r.ids for r in lists.select("i", tokens.encoder(vocab)("pieces").alias("ids")).collect()}
    assert expected[2] == [*vocab_ids(vocab, "the"), vocab.eot, *"zzé".encode()] and expected[4] == [vocab.eot]
    monkeypatch.setattr(tokens, "PIECES_AT_ONCE", at_once)
    assert {r.doc_id: r.tokens for r in tokens.encode_documents(docs(spark).coalesce(1), vocab).collect()} == whole
    assert {r.i: r.ids for r in lists.select("i", tokens.encoder(vocab)("pieces").alias("ids")).collect()} == expected


def vocab_ids(vocab, piece):
    return [256 + vocab.pieces.index(piece)] if piece in vocab.pieces else list(piece.encode())


def test_encoding_needs_little_besides_the_batch(vocab):
    """Two ids' worth of bytes per piece, for the parts and the whole, and not eight."""
    rows, each = 2_000, 1_000
    batch = pa.array([["the", " of", "zz", None] * (each // 4)] * rows, pa.list_(pa.string()))
    encode = tokens.encoder(vocab).func
    tracemalloc.start()
    found = next(encode(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == rows and peak < 8 * len(found.flatten()) + 20e6


def test_rows_reach_python_in_small_batches(spark):
    @F.arrow_udf("long")
    def size(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([batch.nbytes] * len(batch), pa.int64())

    ids = spark.range(3_000).coalesce(1).select(F.sequence(F.lit(1), F.lit(2_500) + F.col("id") % 2).alias("ids"))
    assert ids.select(size("ids").alias("size")).agg(F.max("size")).first()[0] < 6e6


def test_marker_is_text_in_documents_and_an_id_in_samples(spark, vocab):
    text = f"a{chats.END_OF_TEXT}\nb{chats.END_OF_TEXT}"
    document = tokens.encode_documents(docs(spark, [text]), vocab).first().tokens
    assert document.count(vocab.eot) == 1
    sample = tokens.encode_samples(docs(spark, [text]), vocab, "text").first().tokens
    assert sample.count(vocab.eot) == 2 and sample[-1] == vocab.eot


def test_parts_encode_like_whole_samples(spark, vocab):
    rows = [
        (0, t, "user" if t % 2 == 0 else "gpt", f"the of {t} and  <|endoftext|> naïve reply, long enough")
        for t in range(5)
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = tokens.encode_samples(chats.render_turns(turns), vocab).orderBy("turn").collect()
    whole = tokens.encode_samples(chats.render_chat(turns), vocab, "text").first()
    assert sum((r.tokens for r in parts), []) == whole.tokens


def sequential(sizes, size):
    """(shard, start) per document, as one writer in order would place them."""
    places, shard, filled = [], 0, 0
    for n in sizes:
        places.append((shard, filled))
        filled += n
        if filled >= size:
            shard, filled = shard + 1, 0
    return places


def pack(spark, sizes, size, split="train", buckets=None):
    rows = [(split, i, n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "split string, doc_id long, n_tokens long")
    found = packing.pack_token_shards(df, size, buckets).collect()
    return [(r.shard, r.start) for r in sorted(found, key=lambda r: r.doc_id)]


@pytest.mark.parametrize(
    "sizes",
    [[60, 60, 60, 60], [150, 60, 60, 10], [100, 100], [1000], [99, 1, 99, 1, 1], [50] * 9],
)
def test_packing_small(spark, sizes):
    assert pack(spark, sizes, 100) == sequential(sizes, 100)


@pytest.mark.parametrize("size", [7, 100, 999, 100_000])
def test_packing_random(spark, size):
    draw = random.Random(size)
    sizes = [draw.choice([1, 2, 3, 40, 41, 300]) for _ in range(700)]
    assert pack(spark, sizes, size) == sequential(sizes, size)


@pytest.mark.parametrize("buckets", [2, 64])
def test_packing_over_a_tree_of_buckets(spark, buckets):
    sizes = [(i * 37) % 50 + (i % 9 > 0) for i in range(900)]
    assert pack(spark, sizes, 100, buckets=buckets) == sequential(sizes, 100)


@pytest.mark.parametrize(("buckets", "size"), [(2, 90), (64, 90), (1_000, 90), (1_000, 5_000), (1_000, 10**9)])
def test_maps_of_neighbours_compose(buckets, size):
    """Up and down a tree of nodes, against one writer that goes through all documents."""
    draw = random.Random(buckets + size)
    sizes = [draw.choice([0, 1, 2, 30, 41, 300]) for _ in range(3 * buckets)]
    expected, opened, shard, total = [], 0, 0, 0
    level = []
    for node in range(buckets):
        own = sizes[3 * node : 3 * node + 3]
        expected.append((opened, shard))
        through = []
        for n in own:
            total += n
            through.append(total)
            if total - opened >= size:
                opened, shard = total, shard + 1
        rows = pd.DataFrame({"split": "train", packing.BUCKET: node, "n_tokens": own, "through": through})
        level.append(packing._closes(size)(rows))
    levels = [pd.concat(level)]
    while len(levels[-1]) > 1:
        groups = levels[-1].groupby(levels[-1]["node"] // packing.FAN)
        levels.append(pd.concat([packing._composed(size)(rows) for _, rows in groups]))
    states = pd.DataFrame({"node": [0], "opened": [0], "first_shard": [0]})
    for maps in reversed(levels[:-1]):
        joined = maps.assign(parent=maps["node"] // packing.FAN).merge(states.rename(columns={"node": "parent"}), on="parent")
        states = pd.concat([packing._descended(size)(rows) for _, rows in joined.groupby("parent")]).drop(columns="split")
    found = states.sort_values("node")
    assert list(zip(found["opened"], found["first_shard"], strict=True)) == expected


def test_packing_splits_are_independent(spark):
    rows = [("train" if i % 3 else "val", i, 30 + i % 5) for i in range(100)]
    df = spark.createDataFrame(rows, "split string, doc_id long, n_tokens long")
    found = {r.doc_id: (r.shard, r.start) for r in packing.pack_token_shards(df, 100).collect()}
    for split in ("train", "val"):
        mine = [(i, n) for s, i, n in rows if s == split]
        assert [found[i] for i, _ in mine] == sequential([n for _, n in mine], 100)


def test_cap(spark):
    df = spark.createDataFrame([(i, 60) for i in range(3)], "doc_id long, n_tokens long")
    within, capped = packing.cap_tokens(df, 100)
    assert (within.count(), capped) == (2, True)
    within, capped = packing.cap_tokens(df, 181)
    assert (within.count(), capped) == (3, False)
    within, capped = packing.cap_tokens(df)
    assert (within.count(), capped) == (3, False)


def stream(spark, shards, run=5, split="train"):
    """Shards of consecutive numbers, in runs of ``run`` ids."""
    rows = []
    for shard, n in enumerate(shards):
        ids = [1000 * shard + i for i in range(n)]
        rows += [(split, shard, s, len(ids[s : s + run]), ids[s : s + run]) for s in range(0, n, run)]
    return spark.createDataFrame(
        rows, "split string, shard long, start long, n_tokens long, tokens array<int>"
    )


@pytest.mark.parametrize("run", [1, 3, 4, 5, 100])
def test_block_tails(spark, run):
    found = blocks.cut_blocks(stream(spark, [8, 9, 16, 17], run), 2, 4).collect()
    expected = []
    for shard, n in enumerate([8, 9, 16, 17]):
        for batch in range((n - 1) // 8):
            for row in range(2):
                at = 1000 * shard + batch * 8 + row * 4
                expected.append((shard, batch, row, list(range(at, at + 4)), list(range(at + 1, at + 5))))
    assert sorted((r.shard, r.batch, r["row"], r.x, r.y) for r in found) == expected


def test_epochs(spark):
    cut = blocks.cut_blocks(stream(spark, [17]), 2, 4)
    again = blocks.repeat_epochs(cut, 3)
    assert again.count() == 3 * cut.count()
    assert {r.epoch for r in again.collect()} == {0, 1, 2}


@pytest.mark.parametrize("pos", [0, 3, 8, 12, 40])
def test_resume_goes_on_at_the_cursor(spark, pos):
    found = blocks.resume_blocks(stream(spark, [30, 33, 20]), 1, pos, 2, 4).collect()
    firsts = sorted(r.x[0] for r in found)
    left = max(33 - pos, 0)
    expected = [1000 + pos + 4 * i for i in range((left - 1) // 8 * 2)] if left else []
    assert firsts == expected + [2000 + 4 * i for i in range(19 // 8 * 2)]


def test_windows(spark):
    found = blocks.sample_windows(stream(spark, [10], 3), "train", 50, 4).collect()
    assert {r.first for r in found} == set(range(6))
    assert len(found) == 50
    for r in found:
        assert r.x == list(range(r.first, r.first + 4))
        assert r.y == list(range(r.first + 1, r.first + 5))


def test_pairs_cross_documents_but_not_shards(spark):
    rows = [("t", 0, 0, 0, [5, 9]), ("t", 1, 0, 2, [6, 7, 9]), ("t", 2, 1, 0, [8, 9])]
    packed = spark.createDataFrame(
        rows, "split string, doc_id long, shard long, start long, tokens array<int>"
    )
    members = packed.withColumn("opens", F.col("start") == 0)
    found = sorted((r.token, r.next) for r in blocks.next_token_pairs(members, 9).collect())
    assert found == [(5, 9), (6, 7), (7, 9), (8, 9), (9, 6)]


def test_concat_stream(spark):
    rows = [("a" if i % 3 else "b", i, [i] * (i % 4), i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "split string, k long, tokens array<int>, n_tokens long")
    placed = blocks.stream_positions(blocks.concat_stream(df, ["k"], F.col("k"))).collect()
    for split in ("a", "b"):
        ids = [r.token for r in sorted(placed, key=lambda r: r.pos) if r["split"] == split]
        assert ids == [t for s, _, run, _ in rows if s == split for t in run]
        assert sorted(r.pos for r in placed if r["split"] == split) == list(range(len(ids)))


def test_files_round_trip(spark):
    for header in (True, False):
        path = new_folder(spark, "files")
        written = token_files.export_token_shards(stream(spark, [30, 7]), path, 50_257, header)
        sizes = {r.shard: r.bytes for r in written.collect()}
        assert sizes == {0: 60 + 1024 * header, 1: 14 + 1024 * header}
        back = token_files.import_token_shards(spark, path, header).orderBy("shard").collect()
        assert [r.tokens for r in back] == [list(range(30)), list(range(1000, 1007))]


def test_the_manifest_of_writing_is_that_of_the_files(spark):
    path = new_folder(spark, "files")
    written = token_files.export_token_shards(stream(spark, [30, 7]), path, 50_257)
    found = {r.shard: (r.docs, r.tokens, r.bytes, r.md5) for r in written.collect()}
    read = {r.shard: (r.bytes, r.md5) for r in token_files.token_file_checksums(spark, path).collect()}
    assert {k: v[2:] for k, v in found.items()} == read
    assert {k: v[1] for k, v in found.items()} == {0: 30, 1: 7}
    assert sum(v[0] for v in found.values()) == stream(spark, [30, 7]).count()
    # A second write adds its shards and replaces those it has written again.
    more = stream(spark, [12]).withColumn("split", F.lit("val")).unionByName(stream(spark, [9]))
    again = token_files.export_token_shards(more, path, 50_257)
    entries = {(r.split, r.shard): (r.tokens, r.md5) for r in again.collect()}
    assert {k: v[0] for k, v in entries.items()} == {("train", 0): 9, ("train", 1): 7, ("val", 0): 12}
    on_disk = token_files.token_file_checksums(spark, path).collect()
    assert {(r.split, r.shard): r.md5 for r in on_disk} == {k: v[1] for k, v in entries.items()}


def test_metadata_lists_shards_and_findings(spark):
    manifest = spark.createDataFrame(
        [("train", 1, 2, 20, "b"), ("train", 0, 1, 30, "a"), ("val", 0, 1, 5, "c")],
        "split string, shard long, docs long, tokens long, md5 string",
    )
    findings = spark.createDataFrame(
        [("val", 0, "warning", "start", "9"), ("train", 12, "error", "missing", "7"), ("train", 1, "error", "magic", None)],
        "split string, shard long, level string, rule string, detail string",
    )
    meta = packing.dataset_meta(manifest, 100, findings).first()
    assert meta.errors == ["train_00001: magic null", "train_00012: missing 7"]
    assert meta.warnings == ["val_00000: start 9"]
    assert [s.md5 for s in meta.train.shards] == ["a", "b"] and meta.train.n_shards == 2
    assert (meta.total_tokens, meta.train.total_tokens, meta.val.total_docs) == (55, 50, 1)
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}", meta.created_at)
    empty = packing.dataset_meta(manifest.limit(0), 100).first()
    assert (empty.total_tokens, empty.errors, empty.val.n_shards) == (0, [], 0)


def test_ids_beyond_16_bits_are_refused(spark):
    big = spark.createDataFrame(
        [("train", 0, 0, 1, [70_000])],
        "split string, shard long, start long, n_tokens long, tokens array<int>",
    )
    with pytest.raises(Exception, match="16 bits"):
        token_files.export_token_shards(big, new_folder(spark, "files"), 100)


def test_reading_in_ranges(spark, monkeypatch):
    path = new_folder(spark, "files")
    token_files.export_token_shards(stream(spark, [30]), path, 100)
    monkeypatch.setattr(token_files, "TASK_IDS", 14)
    reader = token_files.TokenFileReader(path, True, row_ids=8)
    assert len(reader.partitions()) > 1
    back = token_files.import_token_shards(spark, path, row_ids=8).orderBy("start").collect()
    runs = [(0, 8), (8, 8), (16, 8), (24, 6)]
    assert [(r.start, r.n_tokens) for r in back] == runs
    assert sum((r.tokens for r in back), []) == list(range(30))


def planned(path, row_ids=10, **wanted):
    """Ids that the reader would read."""
    ranges = wanted.pop("ranges", None)
    reader = token_files.TokenFileReader(path, True, row_ids, token_files.Wanted(**wanted), ranges)
    return sum(r.count for task in reader.partitions() for r in task.ranges)


def test_only_what_is_wanted_is_read(spark):
    path = new_folder(spark, "files")
    token_files.export_token_shards(stream(spark, [95, 30, 40]), path, 50_257)
    assert planned(path) == 165
    assert planned(path, split="val") == 0
    assert planned(path, split="train", first_shard=1) == 70
    assert planned(path, last_shard=1) == 125
    assert planned(path, first_shard=0, last_shard=0, start=81) == 14
    assert planned(path, start=40) == 55
    assert planned(path, ranges={("train", 0): [(3, 5), (90, 5)]}) == 10
    with pytest.raises(ValueError, match="behind"):
        planned(path, ranges={("train", 1): [(26, 5)]})


@pytest.mark.parametrize("start", [0, 4, 10, 94, 95])
def test_reading_on_from_a_cursor(spark, start):
    path = new_folder(spark, "files")
    token_files.export_token_shards(stream(spark, [95, 30]), path, 50_257)
    read = token_files.read_from(spark, path, "train", 0, start, row_ids=10).orderBy("shard", "start").collect()
    assert sum((r.tokens for r in read), []) == list(range(start, 95)) + list(range(1000, 1030))
    assert all(r.n_tokens == len(r.tokens) for r in read) and (start == 95 or read[0].start == start)


def test_windows_out_of_files(spark):
    path = new_folder(spark, "files")
    token_files.export_token_shards(stream(spark, [95, 30]), path, 50_257)
    windows = blocks.shard_windows(token_files.token_file_manifest(spark, path), 40, 8)
    read = token_files.read_windows(spark, path, windows, 8).collect()
    assert sorted(r.window for r in read) == list(range(40)) and {r.shard for r in read} == {0, 1}
    for r in read:
        assert r.ids == [1000 * r.shard + r.first + k for k in range(9)]


def test_starts_of_blocks_and_of_shards(spark):
    """Every block that begins with end-of-text is found, not the turned shards alone."""
    texts = [(i, " ".join(["zq"] * (200 + 37 * i % 101)), "s", "en") for i in range(150)]
    folder = new_folder(spark, "tables")
    rows = spark.createDataFrame(texts, "doc_id long, text string, source string, lang string")
    rows.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{folder}/documents.parquet")
    corpus = C.token_corpus(spark, folder)
    shards = {}
    for row in corpus.stream.orderBy("split", "shard", "start").collect():
        shards.setdefault((row.split, row.shard), []).extend(row.tokens)
    expected = [(split, 0) for split in {split for split, _ in shards}]
    for (split, shard), ids in shards.items():
        starts = range(0, len(ids), S.BLOCK)
        expected += [(split, shard * 1_000_000 + at // S.BLOCK) for at in starts if ids[at] == corpus.vocab.eot]
    found = QUERIES["check_start"](spark, folder).collect()
    assert sorted((r.split, r.shard) for r in found) == sorted(expected) and len(expected) > 2
    assert {(r.level, r.rule, r.detail) for r in found} == {("warning", "start", str(corpus.vocab.eot))}


def test_faulty_files(spark, tmp_path):
    def write(shard, magic=20240520, count=4, size=100, ids=(1, 2, 3, 4), odd=b""):
        header = np.zeros(256, "<i4")
        header[:4] = magic, 1, count, size
        name = tmp_path / f"train_{shard:05d}.bin"
        name.write_bytes(header.tobytes() + np.array(ids, "<u2").tobytes() + odd)

    write(0)
    write(1, magic=7)
    write(2, size=101)
    write(3, count=104, ids=[1] * 104)
    write(4, count=105, ids=[1] * 105)
    write(5, odd=b"x")
    write(6, ids=(1, 2, 100, 4))
    write(7, ids=(99, 2, 3, 4))
    write(9, magic=8, count=500, ids=(99, 2, 100, 4), odd=b"x")
    (tmp_path / "train_00010.bin").write_bytes(b"abcd")
    path = f"file:{tmp_path}"
    headers = token_files.token_file_headers(spark, path)
    facts = quality.shard_facts(token_files.import_token_shards(spark, path))
    manifest = spark.createDataFrame(
        [("train", i, 4) for i in range(11)], "split string, shard long, tokens long"
    )
    checks = quality.findings(manifest, headers, facts, 100, 99)
    found = {(r.shard, r.level, r.rule) for r in quality.all_findings(checks).collect()}
    assert found == {
        (1, "error", "magic"),
        (2, "warning", "vocab"),
        (4, "warning", "count"),
        (5, "error", "size"),
        (6, "error", "range"),
        (7, "warning", "start"),
        (8, "error", "missing"),
        # A wrong magic or a file without a whole header ends the checks of the file.
        (9, "error", "magic"),
        (10, "error", "magic"),
    }
    assert quality.all_findings(checks).count() == len(found)
    assert tuple(quality.validation_report(checks).first()) == (6, 3, False)
