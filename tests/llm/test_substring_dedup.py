"""Repeated units against a plain scan of all texts."""

import random
import re

from gristmill.llm import substring_dedup as dedup

CLAUSE_END = ".!?,;:"


def plain_units(text):
    """(kind, line start, start, length, words) by walking over the characters."""
    at = 0
    for line in text.split("\n"):
        clauses, start, i = [], 0, 0
        while i < len(line):
            if line[i] in CLAUSE_END:
                j = i
                while j < len(line) and line[j] in CLAUSE_END:
                    j += 1
                if j == len(line) or line[j] in " \t\r\x0b\x0c":
                    while j < len(line) and line[j] in " \t\r\x0b\x0c":
                        j += 1
                    clauses.append((start, j))
                    start = j
                i = j
            else:
                i += 1
        if start < len(line):
            clauses.append((start, len(line)))
        words = lambda s: re.findall(r"[^\W_]+", s.lower())
        if len(words(line)) >= 5:
            yield "line", at, at, len(line), words(line)
        if len(clauses) > 1:
            for a, b in clauses:
                if len(words(line[a:b])) >= 6:
                    yield "clause", at, at + a, b - a, words(line[a:b])
        at += len(line) + 1


def brute(rows):
    found = sorted({(i, *u[:4], " ".join(u[4])) for i, t in rows if i is not None and t for u in plain_units(t)}, key=lambda u: (u[0], u[3]))
    first = {}
    for i, _, _, start, _, key in found:
        first.setdefault(key, (i, start))
    later = [u for u in found if first[u[5]] != (u[0], u[3])]
    gone = {(u[0], u[2]) for u in later if u[1] == "line"}
    return {(u[0], u[3], u[4], u[1], *first[u[5]]) for u in later if u[1] == "line" or (u[0], u[2]) not in gone}


def spans(df):
    return {tuple(r) for r in df.select("doc_id", "start", "n_chars", "unit", "kept_doc_id", "kept_start").collect()}


def test_repeats_equal_brute_force(spark, documents):
    rng = random.Random(2)
    words = ["alpha", "beta", "Gamma", "déjà", "3.5", "x", "word,", "end."]
    lines = [" ".join(rng.choices(words, k=rng.randrange(1, 14))) for _ in range(40)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randrange(0, 8)))) for i in range(60)]
    assert spans(dedup.find_repeats(documents(rows))) == brute(rows)


def test_a_passage_inside_lines_is_found_with_its_offsets(spark, documents):
    passage = "first there are some words here, then a second clause of seven words, and the last one ends here."
    rows = [
        (1, "Ünlike begin " + passage + " and an end"),
        (2, "no repeat at all in this one line of text"),
        (9, "\n\nother begin that differs " + passage + " other end"),
    ]
    found = dedup.find_repeats(documents(rows)).collect()
    texts = dict(rows)
    assert {r.doc_id for r in found} == {9} and {r.kept_doc_id for r in found} == {1}
    for r in found:
        piece = texts[9][r.start : r.start + r.n_chars]
        kept = texts[1][r.kept_start : r.kept_start + r.n_chars]
        assert piece == kept and piece.strip() in passage
    cleaned = {r.doc_id: r.text for r in dedup.remove_repeats(documents(rows)).collect()}
    assert cleaned[1] == texts[1] and cleaned[2] == texts[2]
    assert "second clause" not in cleaned[9] and cleaned[9].startswith("\n\nother begin")


def test_nulls_empty_repeated_rows_and_clashing_names(spark, documents):
    line = "the very same line of five words"
    rows = [(2, line), (1, line), (1, line), (None, line), (3, None), (4, ""), (5, f"{line}\n{line}")]
    docs = documents(rows, clash=("unit", "start", "spans", "kept", "d1"))
    assert spans(dedup.find_repeats(docs)) == {
        (2, 0, 32, "line", 1, 0), (5, 0, 32, "line", 1, 0), (5, 33, 32, "line", 1, 0), (None, 0, 32, "line", 1, 0)
    }
    cleaned = dedup.remove_repeats(docs)
    assert cleaned.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=str)
    assert found == sorted([(2, ""), (1, line), (1, line), (None, ""), (3, None), (4, ""), (5, "\n")], key=str)


def test_long_text_and_empty_table(spark, documents):
    long = "\n".join(f"line number {i} has its own words" for i in range(20_000))
    assert dedup.find_repeats(documents([(1, long), (2, long)])).count() == 20_000
    assert dedup.find_repeats(documents([])).count() == 0
    assert dedup.remove_repeats(documents([])).count() == 0


def test_a_passage_with_short_clauses_goes_whole(spark, documents):
    passage = (
        "first there are some words here, short one, then a second clause of seven words. Yes. No, not now: "
        "the third of them is long enough again, but, as said, it ends with this last long clause."
    )
    rows = [
        (1, "Unlike begin of it; " + passage + " And an end."),
        (4, "Yes. Another text, short one, that shares no run with the first."),
        (9, "Other begin that differs. " + passage + " Other end."),
    ]
    cleaned = {r.doc_id: r.text for r in dedup.remove_repeats(documents(rows)).collect()}
    assert cleaned == dict(rows) | {9: "Other begin that differs. Other end."}


def test_spans_are_cut_only_out_of_the_text_they_were_found_in(spark, documents):
    line, more = "the very same line of five words", "and a second line that is seen only here"
    other = "another text under the same id that shares nothing with them at all"
    rows = [(1, line), (2, f"{line}\n{more}"), (2, other), (None, f"{line}\n{other} now"), (None, other + " too")]
    cleaned = {(r.doc_id, r.text) for r in dedup.remove_repeats(documents(rows)).collect()}
    assert cleaned == {(1, line), (2, f"\n{more}"), (2, other), (None, f"\n{other} now"), (None, other + " too")}


def test_a_passage_repeated_among_texts_without_an_id(spark, documents):
    line = "the very same line of five words"
    rows = [(None, f"{line}\nthe first of them has this"), (None, f"{line}\nand the second has that")]
    cleaned = [r.text for r in dedup.remove_repeats(documents(rows)).collect()]
    assert sum(line in text for text in cleaned) == 1
