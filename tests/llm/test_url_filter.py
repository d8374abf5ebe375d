import pytest

import valuelens.llm.registry as R
from valuelens.llm import url_filter as U
from valuelens.plans.oracle_check import compare, duckdb_connection

ROWS = [(1, "HTTP://WWW.A.Net/x"), (2, "https://b.example.net/en/1?q#f"), (3, "https://example.com/de/x"), (4, "https://myexample.com/de/x"),
        (5, "http://x.org/fr/1"), (6, None), (7, "no scheme"), (8, "https://a.net"), (8, "https://a.net"), (9, "http://ÀB.Org/fr/#x://y"), (None, ""),
        (10, "http://q.example.com/" + "z/" * 30000)]


def test_rules_and_parts(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, host string")
    out = U.filter_urls(df, U.RULES).collect()
    assert len(out) == len(ROWS)
    by = {r.page_id: r for r in out}
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("www.a.net", "/x", "net/", "block")
    assert (by[2].rule, by[2].verdict, by[2].path) == ("example.net/en/", "allow", "/en/1")
    assert by[3].rule == "example.com/de/" and by[4].rule is None and by[5].verdict == "allow"
    assert (by[6].host, by[6].path, by[7].host) == ("", "", "") and by[8].rule is None
    assert by[9].host == "Àb.org" and by[9].rule == "org/fr/"
    assert {r.verdict for r in out} == {"allow", "block"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(df, U.RULES).count() == 0


def test_models_tell_labelled_urls_apart(spark):
    rows = [(i, f"http://cheap{i}.net/pills/{i}") for i in range(80)] + [(100 + i, f"http://good{i}.org/fr/read/{i}") for i in range(80)]
    rows += [(300, "http://cheap.com/pills/7"), (301, "http://good.com/read/7")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    by = {r.page_id: r for r in U.filter_urls(df, U.RULES).collect()}
    assert by[300].score < by[301].score
    assert (by[300].verdict, by[301].verdict) == ("block", "allow")


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_oracle(spark, sf):
    ok, said = compare(spark, duckdb_connection(sf), sf, R.queries()["op2_url_ratio"], R.oracle_sql()["op2_url_ratio"])
    assert ok, said
