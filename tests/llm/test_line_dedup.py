"""Line dedup against a plain version that holds all documents at once."""

import hashlib
import random

import pytest

from gristmill.llm import line_dedup

STRIP = " \t\n\x0b\f\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def key(line):
    return line.strip(STRIP).translate(LOWER)


def brute(rows):
    """(doc_id, n_lines, n_dropped, sha) per row; rows without an id are documents by their text."""
    held = {}
    for doc_id, text in rows:
        name = (doc_id, None) if doc_id is not None else (None, text or "")
        for line in (text or "").split("\n"):
            if len(key(line)) >= line_dedup.LEAST_POINTS:
                held.setdefault(key(line), set()).add(name)
    found = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            holders = held.get(key(line), ())
            last = max((d for d, _ in holders if d is not None), default=None)
            if len(holders) < line_dedup.LEAST_DOCS or doc_id == last:
                kept.append(line)
        sha = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        found.append((doc_id, len(lines), len(lines) - len(kept), sha))
    return found


def result(df, **options):
    return [tuple(row) for row in line_dedup.line_report(line_dedup.dedup_lines(df, **options)).collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


LONG = "A line that is long enough to count, é"


def test_cases(spark, documents):
    rows = [
        (1, f"{LONG}\nown line of the first document"),
        (2, f"  {LONG.lower()}\t\nshort\n\n{LONG}"),  # twice in one document, with white space
        (3, f"x\n{LONG}\x0b\n{LONG}\nx"),  # the largest: both of its lines stay
        (4, None),
        (5, ""),
        (6, "twenty code points é\n" * 3),
        (7, "twenty code points é\n"),
        (8, "nineteen code pts éé\nnineteen code p é"),
        (6, "twenty code points é"),  # a repeated id is no second document
        (9, f"{LONG} \nÉ{LONG}"),
        (9, "another text of the same id\r\n\r\n"),
    ]
    df = documents(rows, clash=("tag", "key", "lines", "pos", "gone", "docs"))
    assert ordered(result(df)) == ordered(brute(rows))


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (3, 2), (8, 2), (8, 4)])
def test_batches_and_levels_change_nothing(documents, batches, fanout):
    draw = random.Random(batches)
    pool = [f"shared line number {i} of the corpus" for i in range(12)] + ["short", "", "  pad  "]
    rows = [(draw.randrange(60), "\n".join(draw.choices(pool, k=draw.randrange(6)))) for _ in range(80)]
    rows += rows[:5]  # whole rows repeated
    assert ordered(result(documents(rows), batches=batches, fanout=fanout)) == ordered(brute(rows))


def test_rows_without_an_id(documents):
    rows = [(None, LONG), (None, f"{LONG}\nb"), (None, None), (7, LONG), (8, f"a\n{LONG}")]
    assert ordered(result(documents(rows), batches=2)) == ordered(brute(rows))
    # None of the holders has an id: one text keeps the line, wherever its row is.
    rows = [(None, f"{LONG}\n{n}") for n in range(4)]
    assert sorted(dropped for _, _, dropped, _ in result(documents(rows))) == [0, 1, 1, 1]
    same = [(None, LONG)] * 5  # copies without an id are one document
    assert [dropped for _, _, dropped, _ in result(documents(same), batches=2)] == [0] * 5


def test_one_row_and_one_line_in_most_documents(documents):
    rows = [(n, f"{LONG}\nline {n}") for n in range(300)] + [(300, f"{LONG}\nrepeated row")] * 200
    assert ordered(result(documents(rows), batches=2)) == ordered(brute(rows))


def test_very_long_text(documents):
    many = "\n".join(f"line number {i} of a very long document" for i in range(20_000))
    rows = [(1, many), (2, many), (3, many + "\nlast")]
    assert ordered(result(documents(rows), batches=2)) == ordered(brute(rows))


def test_empty_table(documents):
    assert result(documents([])) == []


def test_tables_of_runs_leave_the_catalog(spark, documents):
    result(documents([(n, LONG) for n in range(9)]))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
