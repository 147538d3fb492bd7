"""Edited texts, fingerprints and their likeness against a plain version."""

import hashlib
import math
import re

from gristmill.llm import imatch


def plain(rows):
    rows = [(i, t or "") for i, t in rows]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    terms = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
    df = {}
    for _, t in order:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1

    def subsets(word):
        digest = hashlib.sha256(word.encode()).hexdigest()
        return {j for j, k in enumerate(imatch.RATES) if int(digest[4 * j : 4 * j + 4], 16) < 1 << (16 - k)}

    band = {w for w, n in df.items() if imatch.BAND[0] <= math.log(len(rows) / n) <= imatch.BAND[1]}
    kept = {w: subsets(w) for w in band}

    def marks(text):
        found = []
        for j in range(len(imatch.RATES)):
            mine = sorted(w for w in terms(text) & band if j in kept[w])
            found.append(hashlib.md5(" ".join(mine).encode()).hexdigest()[:8] if mine else "0" * 8)
        alone = hashlib.sha256(text.encode()).hexdigest()[:8]
        return found if any(kept[w] for w in terms(text) & band) else [alone] * len(found)

    def near(a, b):
        if a == b:
            return 1.0
        used = [(x, y) for x, y in zip(a, b) if x != "0" * 8 or y != "0" * 8]
        return sum(x == y for x, y in used) / len(used) if used else 0.0

    out = []
    for place, (i, text) in enumerate(order):
        following = order[(place + 1) % len(order)][1]
        n = len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        mine, other, beside = marks(text), marks(edited), marks(following)
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), mine, other, near(mine, other), near(mine, beside)))
    return sorted(out, key=str)


def found(docs, **options):
    rows = imatch.fingerprint_pairs(docs, **options).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_equals_the_plain_version(spark, documents):
    words = [f"w{i}" for i in range(400)]
    rows = [(i * 3 % 101, " ".join(words[(i * 7 + j * j) % 400] for j in range(20 + i))) for i in range(100)]
    rows += [(200, None), (201, ""), (202, "ünïcode 😀 text 😀😀"), (7, rows[0][1]), (7, rows[0][1]), (None, "no id here"), (None, None)]
    docs = documents(rows, clash=("row", "extra", "at", "_bucket", "term", "mask", "side"))
    assert found(docs) == plain(rows)
    equal = [r for r in found(docs) if r[0] == 7]
    assert len({tuple(r[3]) for r in equal}) <= 2


def test_one_document_follows_itself(spark, documents):
    rows = [(5, "just one text that follows itself")]
    assert found(documents(rows)) == plain(rows)


def test_long_texts_and_empty_table(spark, documents):
    rows = [(i, " ".join(f"t{(i + j) % 30_000}" for j in range(20_000))) for i in range(9)]
    assert found(documents(rows)) == plain(rows)
    assert found(documents([])) == []


def test_texts_without_terms_are_like_equal_ones_alone(spark, documents):
    rows = [(1, "of the and"), (2, "of the and"), (3, "and to be"), (4, ""), (5, None), (6, "?!")]
    rows += [(100 + i, "of the and to be") for i in range(30)]
    marks = {r.doc_id: r.marks for r in imatch.fingerprint_pairs(documents(rows)).collect()}
    assert marks[1] == marks[2] and marks[4] == marks[5]
    assert len({tuple(marks[i]) for i in (1, 3, 4, 6, 100)}) == 5
