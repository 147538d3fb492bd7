"""Notices are found in their family, plain text is left alone."""

import pytest

from gristmill.llm import license_scan

FOLDER = "/root/testdata/sf0.001"
PLAIN = [
    "The weather in the north was cold and the people of the town stayed inside for the whole of that day",
    "She may use the new source of water for free but not without the help of all the others in the village",
    "Version after version of the story was told and each one of them ended in the same way as it had begun",
]


def rows():
    notices = {
        1: ("mit", "Released under the MIT License."),
        2: ("apache", "Licensed under the Apache License, Version 2.0."),
        3: ("gpl", "This work is licensed under the GNU General Public License, version 3."),
        4: ("cc", "Licensed under CC BY-NC 4.0."),
        5: ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
        6: ("public_domain", "This is free and unencumbered software released into the public domain."),
    }
    docs = [(i, f"{PLAIN[0]}\n{text}\n{PLAIN[1]}") for i, (_, text) in notices.items()]
    docs += [(7, f"{PLAIN[2]} " * 30 + notices[1][1] + f" {PLAIN[0]}" * 30)]
    docs += [(20 + i, f"{PLAIN[i % 3]}\n{PLAIN[(i + 1) % 3]} {i}") for i in range(40)]
    return notices, docs


def test_families_of_notices(spark, documents):
    notices, docs = rows()
    docs += [(90, None), (91, ""), (None, "nothing here"), (1, docs[0][1])]
    frame = documents(docs, clash=("line", "at", "words", "family", "features", "p"))
    found = license_scan.scan(frame).collect()
    assert {(r.doc_id, r.family) for r in found} == {(i, f) for i, (f, _) in notices.items()} | {(7, "mit")}
    for r in found:
        assert r.probability >= license_scan.MIN_PROBABILITY and r.coverage >= license_scan.MIN_COVERAGE
        assert r.line == (0 if r.doc_id == 7 else 1)


def test_screening_loses_no_covering_span(spark, documents):
    frame = documents(rows()[1])
    templates = license_scan.template_rows(spark)
    words = set(license_scan.anchors(license_scan.plain_spans(frame), templates))
    for row in templates.collect():
        own = set(row["words"])
        assert len(own - words) / len(own) < license_scan.MIN_COVERAGE


def test_spans_cover_every_word(spark, documents):
    text = " ".join(f"w{i}" for i in range(500))
    spans = license_scan.paragraphs(documents([(1, text), (2, None), (3, "a\n\nb c")])).collect()
    assert {w for r in spans if r.doc_id == 1 for w in r["words"]} == set(text.split())
    runs = [set(r["words"]) for r in spans if r.doc_id == 1]
    for i in range(500 - license_scan.STRIDE):
        assert any({f"w{k}" for k in range(i, i + license_scan.STRIDE)} <= run for run in runs)
    assert [(r.line, r["words"]) for r in spans if r.doc_id == 3] == [(0, ["a"]), (2, ["b", "c"])]


def test_empty_table(spark, documents):
    assert license_scan.scan(documents([])).count() == 0


@pytest.mark.parametrize("name", ["apache", "mit", "gpl", "cc"])
def test_lines_of_the_test_data(spark, name):
    marks = {"apache": "Apache License", "mit": "MIT License", "gpl": "GNU General Public", "cc": "CC BY-NC"}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    expected = {r.doc_id for r in docs.collect() if marks[name] in r.text}
    found = license_scan.scan(docs).filter(f"family = '{name}'").collect()
    assert {r.doc_id for r in found} == expected


def test_wrapped_headers_are_found(spark, documents):
    headers = {
        "mit": " * Permission is hereby granted, free of charge, to any person obtaining\n * a copy of this software and"
        " associated documentation files (the\n * \"Software\"), to deal in the Software without restriction",
        "bsd": "# Redistribution and use in source and binary forms, with or\n# without modification, are permitted"
        " provided that the\n# following conditions are met:",
        "apache": "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file"
        " except in compliance with the License.\n// You may obtain a copy of the License at",
        "gpl": " This program is free software: you can redistribute it and/or modify\n it under the terms of the GNU"
        " General Public License as published by\n the Free Software Foundation, either version 3 of the License, or\n"
        " (at your option) any later version.",
    }
    docs = [(i, f"{PLAIN[0]}\n *\n{text}\n\n{PLAIN[1]}") for i, text in enumerate(headers.values())]
    docs += [(20 + i, f"{PLAIN[i % 3]}\n{PLAIN[(i + 1) % 3]} {i}") for i in range(40)]
    found = license_scan.scan(documents(docs)).collect()
    assert {(r.doc_id, r.family) for r in found} == set(enumerate(headers))
    assert len({(r.doc_id, r.line) for r in found}) >= 4 and all(2 <= r.line <= 4 for r in found)


def test_texts_of_one_id_or_none_are_reported_by_themselves(spark, documents):
    notices, docs = rows()
    mit, gpl = notices[1][1], notices[3][1]
    docs = docs[7:] + [(None, f"{mit}\n{PLAIN[0]}"), (None, f"{PLAIN[0]} x\n{mit}"), (60, mit), (60, f"{PLAIN[1]}\n{mit}\n{gpl}")]
    found = [(r.doc_id, r.line, r.family) for r in license_scan.scan(documents(docs)).collect()]
    expected = [(None, 0, "mit"), (None, 1, "mit"), (60, 0, "mit"), (60, 1, "mit"), (60, 2, "gpl")]
    assert sorted(found, key=str) == sorted(expected, key=str)
