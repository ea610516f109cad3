"""Url rules and the classifier on odd rows; the query itself is compared with its twin."""

import pytest
from dnsflow.llm import urls

ODD = [(1, None), (None, ""), (2, "no scheme"), (3, "http://"), (3, "http://"), (4, "HTTP://WWW.Example.COM/en/x?y#z"), (5, "http://éß漢😀.net/es/ü"),
       (6, "x://" + "a." * 5000 + "com/" + "p/" * 5000), (7, "http://com"), (8, "http://.com/"), (9, "http://net/es/"), (10, "a://b://c/d"), (11, "http://x.example.com/en/1"),
       (12, "http://notexample.com/en/1"), (13, "http://x.example.com?/en/"), (14, "http://x.www.example.com/en/")]


@pytest.fixture(scope="module")
def model(spark):
    return urls.train(spark.createDataFrame(urls.LABELLED, "url string, label int"), steps=20)


def test_odd_urls(spark, model):
    df = spark.createDataFrame(ODD, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS path", "3 AS rule", "4 AS fits", "5 AS margin")
    got = urls.judged(df, model, urls.RULES).collect()
    assert len(got) == len(ODD) and urls.judged(df.limit(0), model, urls.RULES).count() == 0
    by = {r.page_id: r for r in got}
    assert all((by[k].host, by[k].path, by[k].rule) == ("", "", None) for k in (1, 2, 3, None))
    rules = {k: (by[k].rule, by[k].verdict) for k in (4, 5, 6, 8, 9, 11, 12, 14)}
    assert rules == {4: ("www.example.com/en/", "allow"), 5: ("net/es/", "block"), 6: ("com/", "allow"), 8: ("com/", "allow"), 9: ("net/es/", "block"),
                     11: ("example.com/en/", "block"), 12: ("com/", "allow"), 14: ("www.example.com/en/", "allow")}
    assert by[7].rule is None and (by[13].host, by[13].path, by[13].rule) == ("x.example.com", "", None) and (by[10].host, by[10].path) == ("b:", "//c/d")
    assert (by[4].host, by[4].path, by[4].margin) == ("www.example.com", "/en/x", None)


def test_the_classifier_knows_names_it_has_not_seen(spark, model):
    rows = [(1, "http://m.casino-best.example.org/en/9"), (1, "http://cheap-viagra-pills.info/de/4"), (0, "http://blog.library-news.org/en/9"), (0, "https://www.weather.example.net/de/1")]
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string"), model, []).collect()
    assert [r.verdict for r in got] == ["block" if r.page_id else "allow" for r in got]
    assert model == urls.train(spark.createDataFrame(urls.LABELLED, "url string, label int").repartition(5), steps=20)
    nothing = urls.train(spark.createDataFrame([("http://a.b/", None)], "url string, label int"))
    assert not any(nothing.weights)
