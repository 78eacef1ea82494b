"""Operator 11: which sources of a language use other words than the rest, by sort-based streaming.

Terms are runs of letters (A-Z lower-cased) and of characters beyond ASCII; a term is kept in a language where
MIN_DOCS of its documents or more hold it. Every (lang, source) group gives each kept term a probability in whole
billionths; two groups differ by the sum of f = (p - q)^2 div (p + q) over all kept terms of their language.

Three passes over sorted runs, all arithmetic in whole numbers:

1. Each task counts a stretch of its documents at a time (bounded by STRETCH entries), so a frequent word leaves a
   task once a stretch and source. Those rows are dealt out by (lang, term, source, salt) and sorted by (lang, term,
   source, stretch); a run-length scan adds up a run in one row of memory. The salt spreads the stretches of a
   frequent word over SALTS tasks.
2. What is left, SALTS rows a group and term at most, is sorted by (lang, term, source); the scan reads a term's run,
   knows its document frequency at its end, and drops or keeps it.
3. The kept counts, with their probabilities, are sorted like that again. A run emits what its sources add to each
   other's sum, added up over many runs before anything leaves the task, and its candidates for the ten strongest
   terms of each source.

A run only pairs sources that hold the term. With p0 the probability of a term that a group lacks, the sum over all V
terms is V f(p0, q0), plus f(p, q0) - f(p0, q0) for terms of one group, which follows from how often each p occurs
there, plus f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) for terms of both, which the runs add up.

Defined cases: null text, lang and source are ''; repeated rows are documents of their own; a group without terms
takes part with all counts 0; a language without kept terms gives pairs of value 0 and no terms; an empty table gives
no rows. Columns other than text, lang and source are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kalendry.llm.common import materialize, prepare

MIN_DOCS, TOP_TERMS = 10, 10
#: Entries (group, term) that a task keeps before it emits them, and tasks over which a group's term is spread.
STRETCH, SALTS = 1 << 19, 16
#: Rows of a scan step, and pairs of sources made at once.
ROWS, PAIRS = 1 << 15, 1 << 20
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms as UTF-8: bytes of characters beyond ASCII are 0x80 or more, so bytes split as characters do."""
    return _TERM.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))


def _stretches(batches):
    """(lang, term, source, stretch, docs, n): one row for each term and group of a stretch of documents."""
    task, number, held, groups = TaskContext.get().partitionId(), 0, 0, {}

    def rows():
        for (lang, source), (n, docs) in groups.items():
            terms, counts = list(n), np.fromiter(n.values(), np.int64, len(n))
            found = np.fromiter(map(docs.__getitem__, terms), np.int64, len(n))
            same = lambda x, k=len(n): pa.array([x], pa.string()).take(pa.array(np.zeros(k, np.int64)))
            stretch = pa.array(np.full(len(n), (task << 24) + number))
            yield pa.RecordBatch.from_arrays([same(lang), pa.array(terms, pa.binary()).cast(pa.string()), same(source), stretch, pa.array(found), pa.array(counts)], names=["lang", "term", "source", "stretch", "docs", "n"])

    for batch in batches:
        for text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            terms = terms_of(text)
            n.update(terms)
            docs.update(set(terms))
            held += len(n)
            if held >= STRETCH:
                yield from rows()
                groups, held, number = {}, 0, number + 1
    yield from rows()


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys start in sorted rows."""
    if not len(table):
        return np.empty(0, np.int64)
    new = np.zeros(len(table), bool)
    new[0] = True
    for k in keys:
        column = table.column(k).combine_chunks()
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.nonzero(new)[0]


def _summed(table: pa.Table, starts: np.ndarray, keys: list[str], sums: list[str]) -> pa.Table:
    first = table.select(keys).take(pa.array(starts))
    for c in sums:
        first = first.append_column(c, pa.array(np.add.reduceat(table.column(c).to_numpy(), starts)))
    return first


def _steps(batches):
    """Batches as tables of ROWS rows or more; the last one may be shorter."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _add_runs(batches):
    """Runs of (lang, term, source) added up; of a run that goes on, one row is held."""
    keys, sums, rest = ["lang", "term", "source"], ["docs", "n"], None
    for table in _steps(batches):
        table = table.select(keys + sums)
        table = table if rest is None else pa.concat_tables([rest, table])
        done = _summed(table, _starts(table, keys), keys, sums)
        rest = done.slice(len(done) - 1)
        yield from done.slice(0, len(done) - 1).combine_chunks().to_batches()
    if rest is not None:
        yield from rest.combine_chunks().to_batches()


def _whole_terms(batches):
    """Tables in which every run of (lang, term) is whole; a run has a few rows for each source."""
    rest = None
    for table in _steps(batches):
        table = table if rest is None else pa.concat_tables([rest, table])
        cut = int(_starts(table, ["lang", "term"])[-1])
        rest = table.slice(cut).combine_chunks()
        if cut:
            yield table.slice(0, cut).combine_chunks()
    if rest is not None:
        yield rest


def _keep(batches, least: int):
    """(lang, term, source, n, first) of terms that enough documents of the language hold; first marks a run's first row."""
    for table in _whole_terms(batches):
        keys = ["lang", "term", "source"]
        rows = _summed(table, _starts(table, keys), keys, ["docs", "n"])
        starts = _starts(rows, ["lang", "term"])
        length = np.diff(np.append(starts, len(rows)))
        docs = np.add.reduceat(rows.column("docs").to_numpy(), starts)
        first = np.zeros(len(rows), np.int64)
        first[starts] = 1
        rows = rows.drop_columns(["docs"]).append_column("first", pa.array(first)).filter(pa.array(np.repeat(docs >= least, length)))
        yield from rows.combine_chunks().to_batches()


def f(p, q):
    return (p - q) * (p - q) // (p + q)


def _meet(batches):
    """(part, lang, source, item, value): sums of pairs that hold the same terms, and the strongest terms of each source."""
    names = ["part", "lang", "source", "item", "value"]
    for table in _whole_terms(batches):
        starts = _starts(table, ["lang", "term"])
        end = np.repeat(np.append(starts[1:], len(table)), np.diff(np.append(starts, len(table))))
        group = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in ("lang", "source")], names=["lang", "source"])
        groups = pa.Table.from_arrays([group.field(0), group.field(1)], names=["lang", "source"]).group_by(["lang", "source"]).aggregate([]).to_pylist()
        code_of = {(g["lang"], g["source"]): i for i, g in enumerate(groups)}
        code = np.fromiter(map(code_of.__getitem__, zip(table.column("lang").to_pylist(), table.column("source").to_pylist(), strict=True)), np.int64, len(table))
        p, p0, q = (table.column(c).to_numpy() for c in ("p", "p0", "q"))

        many = np.cumsum(end - np.arange(len(table)) - 1)  # pairs of a row and the later rows of its run
        at = 0
        while at < len(table):
            before = many[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(many, before + PAIRS, side="right")))
            n = np.diff(np.concatenate([[before], many[at:to]]))
            a = np.repeat(np.arange(at, to), n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            at = to
            if not len(a):
                continue
            value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
            key = code[a] * len(groups) + code[b]
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            edge = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            some = [(groups[k // len(groups)], groups[k % len(groups)]) for k in key[edge].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(edge)), pa.array([x["lang"] for x, _ in some], pa.string()), pa.array([x["source"] for x, _ in some], pa.string()), pa.array([y["source"] for _, y in some], pa.string()), pa.array(np.add.reduceat(value, edge))], names=names)

        own = pa.Table.from_arrays([pa.array(code), pa.array(f(p, q)), table.column("term").combine_chunks(), table.column("lang").combine_chunks(), table.column("source").combine_chunks()], names=["code", "value", "item", "lang", "source"]).filter(pa.array(p > q))
        if len(own):
            own = own.take(pc.sort_indices(own, [("code", "ascending"), ("value", "descending"), ("item", "ascending")]))
            first = _starts(own, ["code"])
            place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
            own = own.filter(pa.array(place < TOP_TERMS))
            yield from own.append_column("part", pa.array(["term"] * len(own))).select(names).combine_chunks().to_batches()


_F = "(({0} - {1}) * ({0} - {1})) div ({0} + {1})"
#: 1 + floor(10^9 (count + 2) / (N + 2 V)), in decimals of 38 digits; null where nothing is kept.
_P = "1 + (cast(1000000000 as decimal(10,0)) * cast({0} + 2 as decimal(20,0))) div nullif(cast({1} + 2 * terms as decimal(20,0)), 0)"


def kept_counts(docs: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n, first) of every kept term and group with it."""
    prepare(docs.sparkSession)
    rows = docs.mapInArrow(_stretches, "lang string, term string, source string, stretch long, docs long, n long")
    keys = ["lang", "term", "source"]
    dealt = rows.repartition(*keys, F.pmod("stretch", F.lit(SALTS))).sortWithinPartitions(*keys, "stretch")
    runs = dealt.mapInArrow(_add_runs, "lang string, term string, source string, docs long, n long")
    met = runs.repartition("lang", "term").sortWithinPartitions(*keys)
    return met.mapInArrow(lambda it: _keep(it, least), "lang string, term string, source string, n long, first long")


def audit(docs: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of sources of a language, and the strongest terms of each source."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = materialize(kept_counts(docs, least), "kept-terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("first").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = materialize(groups.withColumn("p0", F.expr(_P.format("0L", "n"))), "groups")  # a row for each group
    totals = kept.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"))
    known = groups.select("lang", "source", F.col("n").alias("group_n"), "lang_n", "terms", "p0")
    rows = kept.join(known, ["lang", "source"]).join(totals, ["lang", "term"])
    rows = materialize(rows.select("lang", "term", "source", F.expr(_P.format("n", "group_n")).alias("p"), "p0", F.expr(_P.format("of_lang", "lang_n")).alias("q")), "probabilities")

    dealt = rows.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    met = materialize(dealt.mapInArrow(_meet, "part string, lang string, source string, item string, value long"), "met")

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    none = groups.join(other, "lang").where(F.col("source") < F.col("item"))
    none = none.select("lang", "source", "item", F.expr("coalesce(terms * (" + _F.format("p0", "q0") + "), 0)").alias("value"))
    spread = rows.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m")).join(other, "lang").where(F.col("source") != F.col("item"))
    one = spread.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), F.expr(f"m * ({_F.format('p', 'q0')} - {_F.format('p0', 'q0')})").alias("value"))
    both = met.where("part = 'pair'").select("lang", "source", "item", "value")
    pairs = none.union(one).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    terms = met.where("part = 'term'").select("lang", "source", "item", "value").withColumn("rank", place).where(F.col("rank") <= TOP_TERMS)
    names = ("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", place).select(*names).unionByName(terms.withColumn("part", F.lit("term")))
