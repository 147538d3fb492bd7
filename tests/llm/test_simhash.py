"""Fingerprints and components against brute force."""

import random
import re

import xxhash

import corpus_pipeline
from gristmill.llm import components as contraction
from gristmill.llm import simhash
from gristmill.llm.components import connected_components


def fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, distance=4):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


TEXTS = [
    None, "", " \t\n", "one", "One two THREE", "one two three four", "one two three four",
    "ÀÉ straße Ünder WORD x y z", "a b c d e f g a b c d e f g " * 40, "word " * 5000,
]


def test_fingerprints_of_nulls_short_long_and_repeated_texts(spark, documents):
    docs = documents([*enumerate(TEXTS), (5, TEXTS[5]), (None, "no id")], clash=("row", "w", "n", "i", "h", "fp"))
    found = sorted(simhash.fingerprints(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    expected = [*enumerate(map(fingerprint, TEXTS)), (5, fingerprint(TEXTS[5]))]
    assert [(r.doc_id, r.fp % (1 << 64)) for r in found[:-1]] == sorted(expected)
    assert found[-1].doc_id is None


def test_groups_equal_brute_force(spark, documents):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = []
    for base in range(12):
        words = rng.choices(vocabulary, k=200)
        for copy in range(8):
            edited = list(words)
            for _ in range(copy):
                edited[rng.randrange(200)] = rng.choice(vocabulary)
            rows.append((base * 100 + copy, " ".join(edited)))
    rows += [(5000, None), (5001, ""), (4000, " ")]
    rng.shuffle(rows)
    found = {r.doc_id: r.component_id for r in simhash.near_groups(documents(rows)).collect()}
    assert found == components({i: fingerprint(t) for i, t in rows})
    assert len(set(found.values())) < len(rows)


def test_links_lose_no_pair_within_four_bits(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(60):
        center = rng.getrandbits(64)
        for flips in (0, 1, 2, 3, 4, 5, 8):
            fp = center
            for bit in rng.sample(range(64), flips):
                fp ^= 1 << bit
            fps.add(fp)
    frame = spark.createDataFrame([(signed(f), signed(f)) for f in fps], "fp long, root long")
    found = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame).collect()}
    expected = {(a, b) for a in fps for b in fps if signed(a) < signed(b) and (a ^ b).bit_count() <= 4}
    assert found == expected


def test_crowd_of_close_copies_gives_few_rows(spark):
    rng = random.Random(3)
    center = rng.getrandbits(63)
    fps = {center} | {center ^ 1 << a ^ 1 << b for a in range(40) for b in range(a)}
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    assert simhash.stars(frame).count() <= 3 * len(fps)


def broadcast(plan):
    """The lines of a plan that lie below an exchange to all executors."""
    found, above = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if above is not None and depth > above:
            found.append(line)
        else:
            above = depth if "BroadcastExchange" in line else None
    return found


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_row_for_each_variant_is_not_broadcast(spark, tmp_path):
    spark.range(500).selectExpr("xxhash64(id) AS fp", "xxhash64(id) AS root").write.parquet(f"{tmp_path}/fps")
    fps = spark.read.parquet(f"{tmp_path}/fps")
    for found in (simhash.stars(fps.select("fp")), simhash.links(fps)):
        found.collect()
        assert "Join" in executed(found)
        assert not broadcast(executed(found))


def test_near_copies_stage_broadcasts_no_exploded_rows(spark, documents, monkeypatch):
    plans = []

    def recorded(df, name, stage=simhash.stage):
        plans.append((name, executed(df)))
        return stage(df, name)

    monkeypatch.setattr(simhash, "stage", recorded)
    monkeypatch.setattr(contraction, "stage", recorded)
    rng = random.Random(11)
    docs = documents([(i, " ".join(rng.choices("abcdefghijklm", k=30 + i))) for i in range(40)])
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 40
    exploded = [name for name, plan in plans if "Generate explode" in plan]
    assert exploded == ["fingerprints", "pivots", "edges"]
    assert not [line for _, plan in plans for line in broadcast(plan) if "Generate explode" in line]


def test_one_of_each_group_stays(spark, documents):
    long = " ".join(f"word{i}" for i in range(100))
    rows = [(3, long), (1, long), (2, "quite another text about nothing in particular"), (1, long), (None, long)]
    docs = documents(rows, clash=("fp", "component_id", "a", "gone"))
    kept = simhash.near_deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2"]


def test_rows_are_named_by_id_and_text(spark, documents):
    long = " ".join(f"word{i}" for i in range(100))
    other = "quite another text about nothing in particular"
    rows = [(1, long), (2, long), (2, other), (2, other), (None, other + " but this"), (None, None), (None, "")]
    kept = simhash.near_deduplicate(documents(rows)).collect()
    assert {(r.doc_id, r.text or "") for r in kept} == {(1, long), (2, other), (None, other + " but this"), (None, "")}
    assert len(kept) == 4


def test_a_third_of_all_rows_is_one_row(spark, documents):
    rows = [(7, "one and the same text of many words")] * 300 + [(i, f"text {i} " * i) for i in range(1, 6)]
    assert sum(r.doc_id == 7 for r in simhash.near_deduplicate(documents(rows)).collect()) == 1


def test_empty_table(spark, documents):
    docs = documents([])
    assert simhash.near_groups(docs).count() == 0
    assert simhash.near_deduplicate(docs).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200)]
    edges += [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(50)]
    rng.shuffle(edges)
    frame = spark.createDataFrame([*edges, edges[0]], "x long, y long")
    found = {r.node: r.root for r in connected_components(frame).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    near = {n: {n} for n in nodes}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    expected = {}
    for n in sorted(nodes):
        if n in expected:
            continue
        todo, seen = [n], {n}
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        expected |= dict.fromkeys(seen, min(seen))
    assert found == expected
    assert connected_components(frame.limit(0)).count() == 0
