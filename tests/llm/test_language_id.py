"""Held-out accuracy, the hierarchy, and odd texts."""

import zlib

import numpy as np

from gristmill.llm import language_id

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language_id.train(docs)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    found = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_nothing_is_learned_from_held_out_rows(spark, documents):
    rows = [(i, "the cat and the dog", "en" if zlib.crc32(str(i).encode()) % 4 == 2 else "de") for i in range(40)]
    sample = language_id.training_sample(documents(rows))
    assert [r.lang for r in sample.collect()] == ["de"]


def test_odd_texts_and_clashing_names(spark, documents):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(
        [(f"der die und nicht {k} schön", "de") for k in "abcdefgh"] + [(f"the and of with {k} this", "en") for k in "abcdefgh"]
    )]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !?", "en"), (None, "the and of", "en"), (103, "the and of " * 50_000)]
    rows += [(0, rows[0][1], "de")]
    docs = documents(rows, clash=("judged", "held_out", "score", "lang_pred", "doc"))
    model = language_id.train(docs)
    found = language_id.identify(docs, model).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in found}
    assert by_id[100] == by_id[101] == by_id[102] == ("und", 0.0)
    assert by_id[103][0] == "en" and by_id[None][0] == "en"
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {100, 101, 102}
    only = language_id.keep_identified(docs, model, languages=("de",))
    assert {r.lang for r in only.collect()} == {"de"}


def test_empty_or_unlabelled_table(spark, documents):
    for docs in (documents([]), documents([(1, "some text", None)])):
        model = language_id.train(docs)
        assert [r.lang_pred for r in language_id.identify(docs, model).collect()] == ["und"] * docs.count()
    one = language_id.train(documents([(1, "only one label here", "xx")]))
    assert one.predict("whatever") == ("xx", 1.0)


def test_scores_depend_on_the_whole_text():
    short, long = "the and of " * 10, "the and of " * 10 + "nicht und der " * 300_000
    assert not np.allclose(language_id.features(short), language_id.features(long))
