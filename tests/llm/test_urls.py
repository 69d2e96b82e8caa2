import re

from hypothesis import given, settings
from hypothesis import strategies as st

from latticevec.llm import urls
from latticevec.llm.queries import ORACLE_SQL, QUERIES


def as_regex(glob):
    out = re.escape(glob).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return re.compile(out, re.S)


GLOBS = ["*.net/**", "*a*b", "", "?", "**", "a?c*", "*.example.com/de/**", "x" * 70 + "*", "**z**z", "*", "é*"] + [f"*w{i}*" for i in range(40)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab./netxzé?*", max_size=12), max_size=6))
def test_globs(texts):
    texts = [*texts, "x" * 71, "a/w7.w39", "", ".a.net/"]
    row, glob = urls.Globs(GLOBS).match([t.encode() for t in texts])
    got = set(zip(row.tolist(), glob.tolist(), strict=True))
    # A "?" is one byte, so it can't stand for a letter of two.
    expected = {(i, k) for i, t in enumerate(texts) for k, g in enumerate(GLOBS) if as_regex(g.encode().decode("latin-1")).fullmatch(t.encode().decode("latin-1"))}
    assert got == expected


CASES = [
    ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://a.example.net/EN/x", "a.example.net", "/EN/x", "net/", "block"),
    ("https://net/", "net", "/", "net/", "block"),
    ("https://x.net", "x.net", "", None, "allow"),
    ("https://xnet/", "xnet", "/", None, "allow"),
    ("https://a.org/x.net/fr/", "a.org", "/x.net/fr/", None, "allow"),
    ("https://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"),
    ("https://b.example.com/de/q", "b.example.com", "/de/q", "example.com/de/", "block"),
    ("https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("http://m.casino-win.example.com/en/1", "m.casino-win.example.com", "/en/1", None, "block"),
    ("http://casino.example.net/en/1", "casino.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://a.com/casino", "a.com", "/casino", None, "allow"),
    ("http://a.net:80/x", "a.net:80", "/x", None, "allow"),
    ("x://y://z.net/a", "y:", "//z.net/a", None, "allow"),
    ("http://?q", "", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://ÄÖ.net/é", "ÄÖ.net", "/é", "net/", "block"),
    ("http://a.net/" + "p" * 5000, "a.net", "/" + "p" * 5000, "net/", "block"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c[0], "h", "r") for i, c in enumerate(CASES)] + [(None, None, "h", "r")], "page_id long, url string, host string, rule string")
    out = {r["page_id"]: tuple(r)[1:] for r in urls.judge(df).collect()}
    assert [out[i] for i in range(len(CASES))] == [c[1:] for c in CASES] and out[None] == ("", "", None, "allow")
    assert urls.judge(df.limit(0)).count() == 0


def test_query_equals_sql(spark, duck, sf_dir, same):
    same(QUERIES["op2_url_filter"](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL["op2_url_filter"]).df())
