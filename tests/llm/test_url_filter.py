import pytest
from pyspark.sql import functions as F

from quartzframe.llm import url_filter as u


def judged(spark, urls, outcomes=(), **kwargs):
    pages = spark.createDataFrame([(i, x, "h") for i, x in enumerate(urls)], "page_id long, url string, host string")
    known = spark.createDataFrame(list(outcomes), "host string, good int")
    return {r["page_id"]: r for r in u.judge(pages, known, u.RULES, **kwargs).collect()}


def test_parts_and_longest_rule(spark):
    got = judged(spark, ["http://WWW.Example.com/en/1?q=/x", "https://a.example.com/en/x", "https://a.example.com/de/x", "ftp://n.net/fr/#a", "//no", None, "x://", "a://b.net", "a://b.NET/es/"])
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(9)] == [
        ("www.example.com", "/en/1", "www.example.com/en/"), ("a.example.com", "/en/x", "example.com/en/"), ("a.example.com", "/de/x", "com/"), ("n.net", "/fr/", "net/fr/"), ("", "", None), ("", "", None), ("", "", None), ("b.net", "", None), ("b.net", "/es/", "net/es/"),
    ]
    assert [got[i]["verdict"] for i in (0, 1, 2, 3, 8)] == ["allow", "block", "allow", "block", "block"]


def test_bad_hosts_are_blocked_and_sparse_ones_lean_on_their_domain(spark):
    known = [("bad.x.org", 0)] * 40 + [("good.x.org", 1)] * 40 + [("a.y.org", 1)] * 60 + [("b.y.org", 1)] * 60 + [("a.z.org", 0)] * 30 + [("b.z.org", 0)] * 30
    got = judged(spark, ["h://bad.x.org/", "h://good.x.org/", "h://new.y.org/", "h://new.z.org/", "h://new.unseen.org/"], known)
    assert got[0]["verdict"] == "block" and got[1]["verdict"] == "allow" and got[2]["verdict"] == "allow" and got[3]["verdict"] == "block"
    assert got[3]["rate"] < got[4]["rate"] < got[2]["rate"]


def test_empty_tables(spark):
    assert judged(spark, []) == {}
    assert judged(spark, ["h://a.org/"])[0]["verdict"] == "block"  # no outcome at all: the bound of the prior is low


def test_registered_domain(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("b.org",), ("",), ("x",)], "h string").select(*u.registered_domain(F.col("h"), r'^co\.uk$'))
    assert [tuple(r) for r in df.collect()] == [("b.co.uk", "co.uk"), ("b.org", "org"), ("", ""), ("x", "x")]


@pytest.mark.parametrize("groups,low,high", [([(5, 10)] * 200, 300, 1000), ([(10, 10)] * 50 + [(0, 10)] * 50, 1, 1)])
def test_concentration_follows_the_spread(spark, groups, low, high):
    df = spark.createDataFrame(groups, "good long, seen long")
    assert low <= u._concentration(df, u.Reputation(), "k").first()["k"] <= high


def test_hosts_with_outcomes_but_no_page_count_for_their_domain(spark):
    known = [("a.y.org", 1)] * 60 + [("a.z.gov.uk", 0)] * 60
    got = judged(spark, ["h://new.y.org/", "h://new.z.gov.uk/", "h://new.y.org/" + "p" * 100_000, "h://new.y.org/"], known)
    assert [got[i]["verdict"] for i in range(4)] == ["allow", "block", "allow", "allow"]
    assert got[0]["rate"] == got[2]["rate"] == got[3]["rate"] > 0.9
