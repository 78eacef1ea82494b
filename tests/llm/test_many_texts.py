import numpy as np
import pyarrow as pa

from kalendry.llm import substring
from kalendry.llm.common import parts_of, word_hashes, word_hashes_of

WORDS = [f"w{i}" for i in range(40)]


def texts():
    rng = np.random.default_rng(3)
    some = [" ".join(rng.choice(WORDS, n)) for n in (0, 3, 4, 5, 60, 200, 46, 49, 50, 51, 2000)]
    return [None, "", " ", *some, some[-1], "ΣΑΣ   x y", "a\x1eb", None]


def batch(of):
    n = len(of)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array(of, pa.string())], names=["row", "doc_id", "text"])


def rows(batches, least):
    return sorted(tuple(r.values()) for b in substring._window_rows(batches, least) for r in b.to_pylist())


def test_words_of_many_texts_are_those_of_each():
    of = texts()
    found, count = word_hashes_of(of)
    alone = [word_hashes(t) for t in of]
    assert count.tolist() == [len(x) for x in alone] == [len((t or "").split()) for t in of]
    assert found.tolist() == np.concatenate(alone).tolist()


def test_no_window_crosses_texts():
    of = texts()
    for least in (1, 10, 46):
        each = [r for i in range(len(of)) for r in rows([batch(of).slice(i, 1)], least)]
        assert rows([batch(of)], least) == sorted(each)
        assert each


def test_parts_cover_a_list():
    of = texts()
    for size in (1, 100, 10**6):
        parts = list(parts_of(of, size))
        assert [i for a, b in parts for i in range(a, b)] == list(range(len(of)))
    assert list(parts_of([])) == []
