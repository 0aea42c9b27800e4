from __future__ import annotations

from promolift.llm import url_rules
from tests.llm.helpers import rows


def pages(spark, given):
    full = [(n, url, html, "x", "y") for n, url, html in given]
    return spark.createDataFrame(full, "page_id LONG, url STRING, html STRING, node STRING, host STRING").repartition(2)


def verdicts(spark, given, **options):
    return {row.id: (row.host, row.path, row.rule, row.verdict) for row in url_rules.judge(pages(spark, given), **options).collect()}


def test_rules(spark):
    found = verdicts(
        spark,
        [
            (1, "http://WWW.Example.com/en/1?x#y", None),
            (2, "http://m.example.com/en/1", ""),
            (3, "http://example.com/EN/", ""),
            (4, "https://a.net/es/", ""),
            (5, "https://net/fr/x", ""),
            (6, "https://notnet/fr/x", ""),
            (7, "https://com", ""),
            (8, None, ""),
            (9, "no scheme", ""),
            (10, "x://y.com/a://b/c#d?e", ""),
        ],
    )
    assert found[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert found[2] == ("m.example.com", "/en/1", "example.com/en/", "block")
    assert found[3] == ("example.com", "/EN/", "com/", "allow")
    assert found[4][2:] == ("net/es/", "block") and found[5][2:] == ("net/fr/", "block")
    assert found[6][2:] == (None, "allow") and found[7] == ("com", "", None, "allow")
    assert found[8] == found[9] == ("", "", None, "allow")
    assert found[10] == ("y.com", "/a://b/c", "com/", "allow")


def test_decisions_follow_aliases(spark):
    link = '<head><LINK  href="{}" REL=canonical></head>'.format
    refresh = "<meta http-equiv='Refresh' content='0; URL={}'>".format
    given = [
        (1, "http://a.org/1", link("http://x.net/es/1")),  # an alias of a blocked url that is no page
        (2, "http://b.org/2", refresh("http://a.org/1#top")),  # through another page
        (3, "http://c.org/3", link("//x.net/fr/9") + refresh("http://good.com/")),  # allowed and blocked aliases
        (4, "http://d.org/4/", link("/5")),
        (5, "http://d.org/5", ""),
        (6, "https://x.net/de/1", link("page2")),
        (7, "https://e.org/7", '<a rel="canonical" href="http://x.net/es/2">'),
        (8, "https://y.net/es/1", link("http://good.com/")),  # a rule of its own wins
        (2, "http://b.org/2", refresh("http://a.org/1#top")),
    ]
    found = verdicts(spark, given)
    assert {number: row[3] for number, row in found.items()} == {
        1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block",
    }
    assert url_rules.judge(pages(spark, given)).count() == 9
    edges = rows(url_rules.alias_links(pages(spark, given)).distinct(), "a", "b")
    assert ("d.org/4/", "d.org/5") in edges and ("x.net/de/1", "x.net/de/page2") in edges
    assert ("b.org/2", "a.org/1") in edges and len(edges) == 7


def test_empty_table_and_given_links(spark):
    assert verdicts(spark, []) == {}
    links = spark.createDataFrame([("q.org/1", "x.net/es/1"), ("q.org/1", None)], "a STRING, b STRING")
    assert verdicts(spark, [(1, "http://q.org/1", None)], links=links)[1][3] == "block"


def test_plan_is_native(spark):
    plan = url_rules.judge(pages(spark, [(1, "http://a.org/", "<link rel=canonical href=/2>")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
