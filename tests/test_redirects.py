"""Redirect chains: pages, long chains, loops, refused and unknown hops, and the addresses of a page."""

from kalendry.operators import redirects


def test_outcomes(spark):
    rows = [(f"http://a.org/{i}", f"/{i + 1}") for i in range(9)] + [("http://a.org/9", None), ("http://l.org/a", "b"), ("http://l.org/b", "./a/"), ("http://p.org/", "http://10.0.0.1/"), ("http://g.org/", "http://gone.org"), ("http://m.org/", "ftp://a.org"), ("http://self.org/", "#x")]
    df = spark.createDataFrame(rows, "url string, location string")
    got = {r.url: (r.outcome, r.final_url, r.hops) for r in redirects.followed(df.select("url").union(df.select("url")), df).collect()}
    assert len(got) == len(rows)
    assert [got[f"http://a.org/{i}"] for i in (3, 4, 9)] == [("too many", None, 5), ("page", "http://a.org/9", 5), ("page", "http://a.org/9", 0)]
    assert got["http://l.org/a"] == got["http://self.org/"] == ("too many", None, 5)
    assert got["http://p.org/"] == got["http://m.org/"] == ("refused", None, 0) and got["http://g.org/"] == ("unknown", None, 1)
    found = redirects.followed(df.select("url"), df)
    assert {tuple(r) for r in redirects.aliases(found).collect()} == {(f"http://a.org/{i}", "http://a.org/9") for i in range(4, 10)}
    assert redirects.followed(df.limit(0), df).count() == 0
