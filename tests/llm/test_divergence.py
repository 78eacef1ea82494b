"""Operator 11 against its SQL and against plain sums over a table of odd rows."""

from collections import Counter

import duckdb
import pytest

from kalendry.llm import divergence, queries

SF = "/root/testdata/sf0.001"


def plain(rows, least):
    """Rows of audit() by dense sums over every kept term; rows are (text, lang, source)."""
    docs = [(t or "", l or "", s or "") for t, l, s in rows]
    found = [(l, s, divergence.terms_of(t)) for t, l, s in docs]
    out = []
    for lang in {l for l, _, _ in found}:
        held = Counter(w for l, _, ws in found if l == lang for w in set(ws))
        kept = [w for w, n in held.items() if n >= least]
        v, groups = len(kept), sorted({s for l, s, _ in found if l == lang})
        count = {s: Counter(w for l, x, ws in found if (l, x) == (lang, s) for w in ws) for s in groups}
        count[None] = Counter(w for l, _, ws in found if l == lang for w in ws)
        p = {}
        for s in count:
            n = sum(count[s][w] for w in kept)
            p[s] = {w: 1 + 10**9 * (count[s][w] + 2) // (n + 2 * v) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in groups if o != s)
            out += [(lang, s, "pair", o.decode(), -x, i + 1) for i, (x, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][w], p[None][w]), w) for w in kept if count[s][w] and p[s][w] > p[None][w])
            out += [(lang, s, "term", w.decode(), -x, i + 1) for i, (x, w) in enumerate(terms[:10])]
    return sorted(out)


def odd(spark, texts):
    rows = [(i, *t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as n", "'x' as term", "2 as p")


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(queries.DIVERGENCE_SQL)
    got = queries.op11_source_divergence(spark, SF)
    assert [d[0] for d in found.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())


@pytest.mark.parametrize("least", [1, 2, 10])
def test_odd_rows(spark, monkeypatch, least):
    monkeypatch.setattr(divergence, "PAIRS", 3)
    texts = [("The the É ÉTÉ áb", "en", "s1")] * 6 + [(None, None, None), ("", "en", "s3"), ("1 2 3", "en", "s4"), ("the été 字 字 \U0001f600", "en", None), ("the cat", "en", "s2")]
    texts += [("word" * 50000 + " the " * 3000, "en", "s2"), ("the", "", ""), ("nur hier", "de", "s1"), ("nur da", "de", "s2"), ("A_b-c", "en", "s2")]
    got = divergence.audit(odd(spark, texts), least)
    assert sorted(map(tuple, got.collect())) == plain(texts, least)


def test_short_stretches_and_steps_change_nothing(spark, small_docs, monkeypatch):
    rows = [(r.text, r.lang, r.source) for r in small_docs.collect()]
    monkeypatch.setattr(divergence, "STRETCH", 500)
    monkeypatch.setattr(divergence, "ROWS", 100)
    assert sorted(map(tuple, divergence.audit(small_docs).collect())) == plain(rows, divergence.MIN_DOCS)


def test_empty_table(spark, small_docs):
    assert divergence.audit(small_docs.limit(0)).count() == 0
