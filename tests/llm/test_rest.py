"""Language, quality, toxicity, sharding, search, passages and the pipeline."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kalendry.llm import langid, queries, quality, sharding, substring, topk, toxicity
from kalendry.llm.common import crc_fold

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, "  12 !!", (3, "a b"), (3, "a b"), (None, "quelque chose"), "x" * 30000, "word " * 20000]


def test_forward_sums_all_segmentations():
    pieces = langid.pieces_of(PIECES)
    ids = {}
    for end, v in pieces.automaton.iter("▁theand"):
        ids[end + 1 - (v & 0xFF), end + 1] = v >> 8
    table = np.random.default_rng(1).random((pieces.size, 1)) / 100

    def total(at):  # plain recursion over every segmentation
        if at == 7:
            return 1.0
        return sum(table[i, 0] * total(e) for (s, e), i in ids.items() if s == at) + langid.FLOOR * total(at + 1)

    assert np.isclose(langid.forward(pieces, ["▁x", "▁theand"], table)[0][1, 0], np.log(total(0)))
    words, counts = ["▁theand", "▁x"], np.array([2.0, 1.0])
    assert np.isclose((langid.expected(pieces, words, counts, table) * pieces.lengths).sum(), (counts * [7, 2]).sum(), rtol=1e-3)


def test_language_held_out_accuracy_and_defined_cases(spark, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tables = langid.learn(docs.where(crc_fold(4) != 2), PIECES)
    rows = langid.predict(docs, crc_fold(4) == 2, PIECES, tables).where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    odd = langid.predict(make_docs(ODD, extra=True), F.lit(True), PIECES, tables).collect()
    assert len(odd) == len(ODD) and sum(r.lang_pred == "und" for r in odd) == 3
    assert {r.lang_pred for r in langid.predict(make_docs(ODD), F.lit(True), PIECES, langid.learn(make_docs(["a"]), PIECES)).collect()} == {"und"}


def test_long_runs_without_pieces(spark):
    pieces = langid.pieces_of(PIECES)
    run = "\u1225" * 64
    table = np.random.default_rng(3).random((pieces.size, 2)) / 1000
    one, two = (langid.forward(pieces, ["▁" + run[0] * n], table)[0] for n in (10, 2000))
    assert np.isfinite(two).all() and np.allclose(two - one, 1990 * np.log(langid.FLOOR))
    text = "thequickbrownfoxandthelazydog"  # the scaled sums and counts are those of short words
    assert np.allclose(langid.forward(pieces, ["▁" + text], table)[0][0], langid.forward(pieces, ["▁" + text, "▁" + run], table)[0][0])
    each = [langid.expected(pieces, w, np.array(n), table[:, :1]) for w, n in ((["▁" + text], [2.0]), (["▁" + run], [3.0]), (["▁" + text, "▁" + run], [2.0, 3.0]))]
    assert np.allclose(each[0] + each[1], each[2])
    docs = [(i, f"the cat and the dog {i}" if i % 2 else f"le chat et le chien {i}", "en" if i % 2 else "fr") for i in range(40)]
    docs = spark.createDataFrame([*docs, (50, f"the {run} cat", "en")], "doc_id long, text string, lang string")
    tables = langid.learn(docs, PIECES)
    assert all(np.isfinite(t).all() for t in tables.values())
    asked = spark.createDataFrame([(1, f"the dog and the cat {run}"), (2, f"le chien {run} et le chat")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(asked, F.lit(True), PIECES, tables).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "fr" and all(0 < r.score <= 1 for r in got.values())


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the cat {i}", "en") for i in range(3000)] + [(3000 + i, "le chat", f"rare{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.learn(docs, PIECES, 20)) == {"en", *(f"rare{i}" for i in range(5))}


def test_quality_and_toxicity(spark, make_docs):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    q = queries.op6_quality(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.quality == r.predicted for r in q]) > 0.9
    t = queries.op9_toxicity(spark, sf).join(labels.withColumnRenamed("toxic", "marked"), "doc_id").collect()
    assert np.mean([r.toxic == r.marked for r in t]) > 0.95
    docs = make_docs(ODD, extra=True)
    vectors = quality.word_vectors(docs)
    none = labels.limit(0).select("doc_id", F.col("quality").alias("label"))
    assert [r.score for r in quality.score(docs, vectors, quality.train(docs, none, vectors)).collect()] == [0.5] * len(ODD)
    assert quality.score(docs.limit(0), quality.word_vectors(docs.limit(0)), quality.Network(np.zeros((0, 256)), np.zeros(0))).count() == 0
    vocabulary, chain = toxicity.learn(docs, labels.limit(0), ["toxic"])
    assert all(r.probabilities[0] < 0.01 for r in toxicity.score(docs, vocabulary, chain).collect())


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (600, 4)).astype(float)
    y = np.column_stack([x[:, 0], x[:, 0] * x[:, 1]])
    chain = toxicity.Chain(x, y)
    assert len(chain.links[1]) == len(chain.links[0]) + 1
    assert ((chain.predict(x) >= 0.5) == y).mean() > 0.99


def test_sharding(spark, small_docs, tmp_path):
    t = sharding.ShardedTable(spark, f"file://{tmp_path}/t", target_bytes=400_000, fanout=2)
    for i in range(5):
        t.append(small_docs.where(F.col("doc_id") % 5 == i), rows_per_shard=20)
    many = len(t.current().shards)
    before, base = t.current().version, t.current()
    done = t.compact()
    assert len(done.shards) < many and done.version > before
    assert len(done.shards) > 1 and max(s.bytes for s in done.shards) <= 1.2 * t.target
    as_set = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    assert as_set(t.read()) == as_set(small_docs)
    with pytest.raises(sharding.Conflict):
        t.commit(base, ())
    report = sharding.shard_report(t).collect()
    assert sum(r.n_rows for r in report) == small_docs.count() and {r.version for r in report} == {done.version}
    assert t.append(small_docs.limit(0)).shards == done.shards


def test_sharding_keeps_all_columns_and_uncommitted_shards(spark, tmp_path):
    t = sharding.ShardedTable(spark, f"file://{tmp_path}/t", fanout=2)
    rows = spark.range(40).selectExpr("id doc_id", "repeat('x', 50) text")
    t.append(rows.where("doc_id < 20"))
    t.append(rows.where("doc_id >= 20").selectExpr("*", "doc_id * 2 more"))
    other = sharding.ShardedTable(spark, t.folder, fanout=2)  # has written its shards, but not committed
    spark.range(40, 50).selectExpr("id doc_id", "'y' text").coalesce(1).write.parquet(f"{t.folder}/data/late")
    before = t.current()
    done = t.compact()
    assert len(done.shards) < len(before.shards)
    assert t.read(before.version).count() == 40  # until vacuum() the versions before can be read
    assert t.vacuum(keep=1) == len({s.path for s in before.shards} - {s.path for s in done.shards})
    other.commit(other.current(), done.shards + other._written(f"{t.folder}/data/late", 0))
    got = sorted((r.doc_id, r.more) for r in t.read().collect())
    assert got == [(i, i * 2 if 20 <= i < 40 else None) for i in range(50)]
    spark.range(5).write.parquet(f"{t.folder}/data/lost")
    assert t.vacuum() == 0 and t.vacuum(unknown_after=-60) > 0 and t.read().count() == 50


def test_sharding_without_rows_and_with_two_writers(spark, tmp_path):
    t = sharding.ShardedTable(spark, f"file://{tmp_path}/t", fanout=2)
    assert t.read().count() == 0 and t.vacuum() == 0 and sharding.shard_report(t).count() == 0
    t.append(spark.range(0).selectExpr("id doc_id", "'x' `a-b`"))
    assert t.read().columns == ["doc_id", "a-b"] and t.read().count() == 0
    other = sharding.ShardedTable(spark, t.folder, fanout=2)
    commit, lost = t.commit, []

    def late(base, *new):  # another writer commits between reading the version and the first attempt
        if not lost:
            lost.append(other.append(spark.range(3).selectExpr("id doc_id", "'y' `a-b`")))
        return commit(base, *new)

    t.commit = late
    t.append(spark.range(3, 5).selectExpr("id doc_id", "'z' `a-b`"))
    assert sorted(r.doc_id for r in t.read().collect()) == [0, 1, 2, 3, 4]
    t.compact()
    assert sorted(tuple(r) for r in t.read().collect()) == [(0, "y"), (1, "y"), (2, "y"), (3, "z"), (4, "z")]


def test_topk_with_many_equal_vectors(spark):
    rows = [(i, [1.0, 0.5]) for i in range(400)] + [(i, [0.25, 2.0]) for i in range(400, 420)] + [(50, [1.0, 0.5])] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect())
    ints = [(i, [int(256 * x) for x in v]) for i, v in rows]
    want = []
    for i, q in {i: q for i, q in ints if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ints if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_topk_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 320)]
    rows += [(400, None), (401, []), (402, [float("nan")] * 8), (403, [None] * 8), (450, [1.0, 2.0]), (500, [3.0, 4.0]), (None, [0.1] * 8), (310, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect())
    sound = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in {i: q for i, q in sound if i % 50 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in sound if j != i and len(v) == len(q))[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert got == sorted(want)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_windows_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(50):
        v = rng.integers(0, 12, rng.integers(1, 40)).astype(np.uint64)
        want = set()
        for i in range(len(v)):
            for j in range(i + 5, len(v)):
                c = i + int(v[i : j + 1].argmin())
                left = max([k + 1 for k in range(c) if v[k] <= v[c]], default=0)
                right = min([k - 1 for k in range(c + 1, len(v)) if v[k] < v[c]], default=len(v) - 1)
                want.add((left, c, right))
        assert set(zip(*(x.tolist() for x in substring.windows(v, 6)), strict=True)) == want


def test_passages(make_docs):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**7)}"
    passage, near = [word() for _ in range(70)], None
    near = passage[:30] + ["changed"] + passage[31:]
    text = lambda p: " ".join([word() for _ in range(rng.randrange(20, 300))] + p + [word() for _ in range(40)])
    texts = [text(passage) for _ in range(30)] + [text([]) for _ in range(30)] + [text(near), text(passage[:35]), "", None, (10, "dup id other text")]
    docs = make_docs(texts, extra=True)
    found = substring.repeats(docs).collect()
    assert {r.doc_b for r in found} == {*range(1, 30), 60} and all(r.doc_a < r.doc_b and r.end_b - r.start_b >= 50 for r in found)
    kept = {(r.doc_id, r.text) for r in substring.remove_repeats(docs).collect()}
    assert len(kept) == len(texts) and (0, texts[0]) in kept and (61, texts[61]) in kept and (62, "") in kept and (63, None) in kept
    assert all(" ".join(passage[5:60]) not in (t or "") for i, t in kept if i and i != 10)
    assert substring.repeats(docs.limit(0)).count() == 0



def test_passages_of_likeness_near_the_threshold_are_candidates():
    rng, lost = random.Random(8), 0
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for _ in range(1000):  # one changed word: 41 of 46 shingles are shared, likeness 0.804
        passage = words(50)
        texts = [" ".join(words(26) + p + words(26)) for p in (passage, passage[:24] + words(1) + passage[25:])]
        rows = pa.table({"row": [0, 1], "doc_id": [0, 1], "text": texts}).to_batches()
        by = {}
        for b in substring._window_rows(rows, 46):
            for value, row, packed in zip(*(b.column(c).to_pylist() for c in ("value", "row", "packed")), strict=True):
                by.setdefault(value, {})[row] = packed
        lost += not substring.joined_intervals([(v[0], v[1]) for v in by.values() if len(v) == 2])
    assert lost == 0


def test_gaps_as_long_as_the_likeness_allows():
    rng = np.random.default_rng(9)
    some = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)
    for n, k, old in ((96, 10, 10), (300, 30, 30), (96, 15, 0), (90, 0, 15)):  # replaced, inserted, left out; all 0.8 or more
        p = some(n)
        a, b = np.concatenate([some(40), p, some(40)]), np.concatenate([some(70), p[: n // 2], some(k), p[n // 2 + old :], some(20)])
        assert substring.matching(a, b, 46, 0.8) == [(40, 39 + n, 70, 69 + n + k - old)]
    p = some(60)
    for k in (5, 40):  # too far apart for one passage: either part is one of its own, or none is
        a, b = np.concatenate([p, some(9)]), np.concatenate([p[:20], some(k), p[20:40], some(k), p[40:], some(9)])
        assert substring.matching(a, b, 46, 0.8) == ([(0, 59, 0, 69)] if k == 5 else [])
    p = [some(50) for _ in range(2)]
    a, b = np.concatenate([p[0], some(40), p[1]]), np.concatenate([p[0], some(60), p[1]])
    assert [m[2:] for m in substring.matching(a, b, 46, 0.8)] == [(0, 49), (110, 159)]


def test_windows_on_both_sides_of_an_insertion_are_joined():
    at = lambda c, left, right, h: c << 36 | left << 27 | right << 18 | h << 15
    pairs = [(at(100, 40, 60, 0), at(200, 40, 75, 0)), (at(140, 60, 40, 1), at(255, 75, 40, 1))]
    assert substring.joined_intervals(pairs) == [(60, 180, 160, 295)]


def test_passage_of_frequent_lines(make_docs):
    rng = random.Random(10)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    text = lambda p: " ".join(words(60) + p + words(60))
    lines = [(words(30), words(30)) for _ in range(40)]
    texts = [text(p) for _ in range(2) for pair in lines for p in pair] + [text(one + two) for one, two in lines for _ in range(2)]
    found = {(r.doc_a, r.doc_b) for r in substring.repeats(make_docs(texts)).collect()}
    assert found == {(i, i + 1) for i in range(160, 240, 2)}


def test_fragments_of_a_passage_do_not_hide_it(make_docs):
    """Two documents with a passage whose halves earlier documents hold singly."""
    for seed in range(2):
        rng = random.Random(seed)
        words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
        text = lambda p: " ".join(words(60) + p + words(60))
        whole = words(90)
        texts = [text(whole[45:]) for _ in range(8)] + [text(whole[:45]) for _ in range(8)] + [text(whole), text(whole)]
        assert {(r.doc_a, r.doc_b) for r in substring.repeats(make_docs(texts)).collect()} == {(16, 17)}


def test_every_exact_repeat_and_most_near_ones_are_found(spark, small_docs, make_docs):
    """All 50-word windows of all documents are compared; then made passages of likeness 0.8 and more."""
    texts = {r.doc_id: (r.text or "").lower().split() for r in small_docs.collect()}
    first, held = {}, {}
    for i in sorted(texts):
        for at in range(len(texts[i]) - 49):
            gram = tuple(texts[i][at : at + 50])
            if first.setdefault(gram, i) != i:
                held.setdefault(i, set()).update(range(at, at + 50))
    covered = {}
    for r in substring.repeats(small_docs).collect():
        covered.setdefault(r.doc_b, set()).update(range(r.start_b, r.end_b))
    assert held and all(places <= covered.get(i, set()) for i, places in held.items())

    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    made = []
    for _ in range(300):
        passage = words(rng.randrange(50, 120))
        other = list(passage)
        for _ in range(len(passage) // 50):
            other[rng.randrange(5, len(other) - 5)] = words(1)[0]
        made += [" ".join(words(40) + p + words(40)) for p in (passage, other)]
    found = {(r.doc_a, r.doc_b) for r in substring.repeats(make_docs(made)).collect()}
    assert sum((i, i + 1) in found for i in range(0, 600, 2)) >= 0.97 * 300 and len(found) <= 300


def test_large_runs_are_thinned_without_loss(make_docs, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_A", 20)
    monkeypatch.setattr(substring, "BLOCK_B", 30)
    rng = random.Random(13)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    line = words(35)
    texts = [" ".join(words(60) + line + words(60)) for _ in range(120)]
    for _ in range(40):
        more = words(30)
        texts += [" ".join(words(60) + line + more + words(60)) for _ in range(2)]
    found = {(r.doc_a, r.doc_b) for r in substring.repeats(make_docs(texts)).collect()}
    assert found == {(i, i + 1) for i in range(120, 200, 2)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert toxic.columns == docs.columns and dict(toxic.dtypes) == dict(docs.dtypes) and 0 < toxic.count() < docs.count()
    ids = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    assert ids and ids <= {r.doc_id for r in toxic.select("doc_id").collect()}
