"""Operator 13 against n-gram strings, zlib and a plain sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from kalendry.llm import queries, resampling

SF = "/root/testdata/sf0.001"


def plain_features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target):
    own = [(d, *plain_features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in plain_features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for d, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted(((d, n, w, x, rank.get(d) if words >= 20 else None) for d, words, n, w, x in rows), key=repr)


def test_query(spark, small_docs):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op13_importance_resampling(spark, SF)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, got.collect()), key=repr) == plain([(r.doc_id, r.text) for r in small_docs.collect()], target)


def test_crc_carried_over_any_length():
    rng = random.Random(3)
    for n in [0, 1, 5, 63, 64, 65, 127, 1000, 4097, 100_003]:
        a, b = rng.randbytes(7), rng.randbytes(n)
        carried = resampling.carry(np.array([zlib.crc32(a)], np.uint32), np.array([n]))
        assert int(carried[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_odd_rows_long_texts_and_parts(spark, make_docs, monkeypatch):
    texts = [None, "", " .. ", "One two THREE", "É é 字 a1b2", "x" * 300_000 + " y", "same words here " * 10, "same words here " * 10, "a b c d e f " * 5000, *["w%d " % i * 25 for i in range(40)]]
    docs = make_docs(texts, extra=True)
    want = plain(list(enumerate(texts)), ["one two three", None, "w1 w1 w2"])
    target = spark.createDataFrame([("one two three",), (None,), ("w1 w1 w2",)], "text string")
    assert sorted(map(tuple, resampling.resample(docs, target).collect()), key=repr) == want
    monkeypatch.setattr(resampling, "STRETCH", 1000)
    assert sorted(map(tuple, resampling.resample(docs, target).collect()), key=repr) == want


def test_empty_tables_null_and_repeated_ids(spark, make_docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(make_docs([]), none).count() == 0
    rows = [(None, "a " * 30), (7, "a " * 30), (7, "a " * 30), (8, "a " * 30)] + [(i, "b c " * 20) for i in range(10, 50)]
    got = resampling.resample(make_docs(rows), none).collect()
    assert len(got) == len(rows)
    drawn = sorted(r["rank"] for r in got if r["rank"])
    assert drawn == [1, 2] and all(r.score <= min(x.score for x in got if x["rank"]) for r in got if not r["rank"])
