import pytest

from tillspark.llm.queries import RULES
from tillspark.llm.url_filter import Rule, judge

PAGE = "page_id long, url string, html string"


def link(url):
    return f'<head><LINK class=x rel="canonical" href="{url}"></head>'


def verdicts(spark, rows, rules=RULES):
    df = spark.createDataFrame(rows, PAGE).selectExpr("*", "'x' AS key", "'x' AS host", "'x' AS verdict", "'x' AS class")
    return {r.page_id: r for r in judge(df, rules).collect()}


def test_rules(spark):
    urls = ["http://a.example.com/en/1", "http://www.Example.COM/en/1", "http://x.www.example.com/en/", "http://example.com/de/en/", "http://b.net/es/",
            "http://b.net/en/", "http://notexample.com/en/", "http://com", "http://com/", "no url", None, "http://net/fr/x?y=/es/", "http://a.com?x=/",
            "x?u=http://q.org/a#b", "http://É.com/É", ""]
    out = verdicts(spark, [(i, u, None) for i, u in enumerate(urls)])
    assert [out[i].rule for i in range(len(urls))] == [
        "example.com/en/", "www.example.com/en/", "www.example.com/en/", "com/", "net/es/", None, "com/", None, "com/", None, None, "net/fr/", None, None,
        "com/", None]
    assert [out[i].verdict for i in range(6)] == ["block", "allow", "allow", "allow", "block", "allow"]
    assert [(out[i].host, out[i].path) for i in (1, 9, 10, 12, 13, 14)] == [
        ("www.example.com", "/en/1"), ("", ""), ("", ""), ("a.com", ""), ("q.org", "/a"), ("É.com", "/É")]


def test_blocks_are_handed_on_to_aliases(spark):
    rows = [
        (1, "http://m.org/a", link("https://b.net/es/a")),  # blocked by its canonical page, which is in the table
        (2, "http://b.net/es/a", None),
        (3, "https://m.org/a/?utm_source=x#top", None),  # an alias of 1 by its key
        (4, "http://n.org/b", link("//m.org/a?fbclid=3")),  # two links away
        (5, "http://n.org/c", link("/d")), (6, "http://n.org/d", None),
        # A class with a blocked and an allowed page is allowed; the blocked page itself stays blocked.
        (7, "http://p.org/", link("http://b.net/fr/z")), (8, "http://b.net/fr/z", link("http://ok.com/z")), (9, "http://ok.com/z", ""),
        (10, "http://r.org/x/y", '<meta http-equiv="refresh" content="0; URL=http://b.net/es/a">'),
        (11, "http://s.org/", '<!-- <link rel="canonical" href="http://b.net/es/a"> --><script>"<link rel=canonical href=http://b.net/es/a>"</script>'),
        (12, None, link("http://b.net/es/a")), (13, "http://t.org", link("mailto:x")), (14, "http://t.org/u", link("#x")), (2, "http://b.net/es/a", None),
        (15, "http://v.org/w/x", link("../q")), (16, "http://v.org/k/l", link("?utm_id=1")), (17, "http://w.org/?a=1&amp;b", link("http://m.org:80/a")),
    ]
    out = verdicts(spark, rows)
    assert {i for i, r in out.items() if r.verdict == "block"} == {1, 2, 3, 4, 8, 10, 17}


def test_a_url_linked_by_nearly_all(spark):
    rows = [(i, f"http://x{i}.org/", link("http://b.net/es/hub") if i % 3 else None) for i in range(600)] + [(600 + i, "http://x1.org/", None) for i in range(300)]
    rows.append((1000, "http://b.net/es/hub", None))
    out = verdicts(spark, rows)
    assert {i for i, r in out.items() if r.verdict == "block"} == {i for i in range(600) if i % 3} | set(range(600, 900)) | {1000}


@pytest.mark.parametrize("rules", [RULES, [], [Rule("block", "org", "/")]])
def test_empty_tables_and_rules(spark, rules):
    assert verdicts(spark, [], rules) == {}
    assert verdicts(spark, [(1, "http://a.org/", None)], rules)[1].verdict == ("block" if len(rules) == 1 else "allow")
