import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kalendry.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(docs, rows, length=1024):
    """The pieces are the documents' ids, each once, in gapless sequences with little padding."""
    tokenizer = Tokenizer.from_file(PATH)
    ids = defaultdict(list)
    for d in docs:
        ids[d.doc_id].append([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0])
    want = [(k, len(i)) for k, v in ids.items() for i in v]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
        assert any(len(i) == r.doc_tokens and zlib.crc32(np.array(i[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for i in ids[r.doc_id])
    for (doc, n), own in pieces.items():
        copies = want.count((doc, n))
        starts = sorted((r.start, r.length) for r in own)
        at = 0
        for i in range(0, len(starts), copies):
            if copies == 1:
                assert starts[i][0] == at
                at += starts[i][1]
        assert sum(r.length for r in own) == n * copies
    assert {k for k in pieces} == set(want)
    padding = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
        total += at
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding <= packing.SLACK * len(sequences)
    return padding, total


def test_documents(small_docs):
    check(small_docs.collect(), packing.pack(small_docs, PATH).collect())


def test_defined_cases(make_docs):
    docs = make_docs(["", None, "a", "a  b\n\n c ", " lead", "x<|endoftext|>y", "tab\there\xa0nbsp", (3, "z"), (3, "z"), (None, "no id"), "long text " * 30000] + ["same length"] * 500, extra=True)
    check(docs.collect(), packing.pack(docs, PATH).collect())
    assert packing.pack(docs.limit(0), PATH).count() == 0
    assert [tuple(r)[1:] for r in packing.pack(make_docs([None]), PATH).collect()] == [(0, 1, zlib.crc32(bytes(4)), 1, 0, 0)]


# best: the value of a feasible dual solution, (1/3, 1/2, 2/3) and (1/3, 1/3, 1/2)
@pytest.mark.parametrize("capacity,sizes,demand,best", [(10, [3, 5, 7], [10, 10, 10], 15.0), (100, [26, 35, 49], [40, 40, 40], 140 / 3)])
def test_column_generation_reaches_the_bound(capacity, sizes, demand, best):
    patterns, often = packing.cutting_stock(np.array(sizes), np.array(demand, float), capacity, gap=0)
    assert np.allclose(patterns @ often, demand) and (np.array(sizes) @ patterns <= capacity).all()
    assert often.sum() <= best + 1e-6


def test_ids_equal_the_library():
    texts = ["", "a  b\n\n c ", " lead", "<|endoftext|> x", "tab\tq\xa0\x1c\x85 n’s", "日本語 ⅷ \u209d", "Ωmega ñ", "don't I'LL 12345 !!??", "x" * 5000, "\r\n \n", "e\u0301\u200d"]
    tokenizer = Tokenizer.from_file(PATH)
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.Ids(PATH).encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_most_items_go_by_patterns():
    rng = np.random.default_rng(1)
    sizes, demand = np.unique(rng.integers(1, 1024, 50_000), return_counts=True)
    plan = packing.Plan(sizes, demand, 1024)
    assert plan.sequences - plan.stream <= len(sizes)  # rounding leaves less than one pattern of each column
