"""Rules case by case, and shrinkage against the closed form."""

import pytest
from pyspark.sql import functions as F

from gristmill.llm import url_reputation as urls


def judged(spark, rows, outcomes):
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("bad_bound", F.lit("clash"))
    return urls.judge_urls(pages, spark.createDataFrame(outcomes, "host string, bad int"))


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://Blog.Site.ORG/en/5?x=1", "blog.site.org", "/en/5", "org/", "allow"),
        ("http://a.example.org/es/1#t", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
        ("http://x.com/fr/2", "x.com", "/fr/2", "com/fr/", "allow"),
        ("http://x.com/de/2", "x.com", "/de/2", "com/de/", "block"),
        ("http://x.com/DE/2", "x.com", "/DE/2", None, "allow"),
        ("http://x.org", "x.org", "", None, "allow"),
        ("http://x.org?u=http://y.com/de/", "x.org", "", None, "allow"),
        ("no scheme /org/", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    row = judged(spark, [(1, url)], []).first()
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_shrinkage_follows_the_hierarchy(spark):
    outcomes = [("bad.spam.net", 1)] * 400 + [("good.fine.net", 0)] * 400 + [("few.fine.net", 1)] * 2
    outcomes += [(f"h{i}.site{i % 7}.com", int(i % 3 == 0)) for i in range(300)] + [("new.spam.net", None)]
    found = {r.host: r for r in urls.host_reputation(spark.createDataFrame(outcomes, "host string, bad int")).collect()}
    assert found["bad.spam.net"].mean > 0.9 > 0.5 > found["few.fine.net"].mean > found["good.fine.net"].mean
    assert found["new.spam.net"].n == 0 and found["new.spam.net"].mean > found["few.fine.net"].mean
    for r in found.values():
        assert 0 <= r.bad_bound <= r.mean <= 1
    verdicts = {r.page_id: r.verdict for r in judged(
        spark, [(1, "http://bad.spam.net/x"), (2, "http://few.fine.net/x"), (3, "http://good.fine.net/")], outcomes
    ).collect()}
    assert verdicts == {1: "block", 2: "allow", 3: "allow"}


def test_outcomes_come_from_the_labelled_document(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.net/en/7.html?q=1"), (2, "http://a.net/en/8/"), (3, "http://b.net/en/9"), (4, None), (5, "http://b.net/about")],
        "page_id long, url string",
    )
    labels = spark.createDataFrame(
        [(7, 1, 0), (7, 1, 1), (8, 0, None), (9, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int"
    )
    found = sorted(map(tuple, urls.labelled_outcomes(pages, labels).collect()), key=str)
    assert found == sorted([("a.net", 1), ("a.net", 1), ("b.net", None), ("", None), ("b.net", None)], key=str)


def test_repeated_rows_and_empty_tables(spark):
    assert judged(spark, [(1, "http://a.net/")] * 3, [("a.net", 0)]).count() == 3
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert urls.judge_urls(pages, urls.labelled_outcomes(pages, labels)).count() == 0


def test_registered_domains(spark):
    hosts = ["a.b.example.co.uk", "user@www.example.com:8080", "localhost", "", "example.net"]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = urls.registered_domain(F.col("host"))
    found = [tuple(r) for r in frame.select(domain, suffix).collect()]
    assert found == [("example.co.uk", "co.uk"), ("example.com", "com"), ("localhost", "localhost"), ("", ""), ("example.net", "net")]
