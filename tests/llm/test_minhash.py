import random
from collections import Counter

import numpy as np

from kalendry.llm import minhash


def bag(text):
    words = text.lower().split()
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def brute(texts):
    bags, root = [bag(t or "") for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= 0.8:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))]


def test_registers_estimate_weighted_jaccard():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    a, b = [rng.choice(words[:30]) for _ in range(400)], [rng.choice(words[10:]) for _ in range(300)]
    x, y = Counter(a), Counter(b)
    truth = sum((x & y).values()) / sum((x | y).values())
    sig = minhash.signatures([minhash.multiset(" ".join(a), 1), minhash.multiset(" ".join(b), 1)], 4000)
    assert abs((sig[0] == sig[1]).mean() - truth) < 0.04
    assert minhash.likeness(*(minhash.units(*minhash.multiset(" ".join(w), 1)) for w in (a, b))) == truth


def test_classes_equal_brute_force(small_docs):
    rows = sorted(small_docs.collect(), key=lambda r: r.doc_id)
    want = {r.doc_id: rows[c].doc_id for r, c in zip(rows, brute([r.text for r in rows]), strict=True)}
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(small_docs).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_chains_and_large_groups_keep_every_link(make_docs):
    rng = random.Random(2)
    base = [f"t{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(60):  # a chain: the last has little in common with the first
        base = list(base)
        base[rng.randrange(120)] = f"t{rng.randrange(10**6)}"
        texts.append(" ".join(base))
    texts += [" ".join(base)] * 30 + ["un autre texte tout seul ici"]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(make_docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_defined_cases(make_docs, spark):
    docs = make_docs(["", None, "  \n", "a b", "A  b", (3, "a b"), (None, "a b c d e f g"), (9, "a b c d e f g"), "x " * 20000], extra=True)
    out = minhash.near_duplicates(docs).collect()
    assert len(out) == 9
    by = {(r.doc_id, r.class_size) for r in out}
    assert {(0, 1), (1, 1), (2, 1), (3, 3), (4, 3), (None, 2), (9, 2), (8, 1)} == by
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, len(r.text or "")) for r in kept.collect()) == [(0, 0), (1, 0), (2, 3), (3, 3), (8, 40000), (9, 13)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 and minhash.keep_one(docs.limit(0)).count() == 0


def test_blocks_link_what_the_pivot_misses():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    words = [str(x) for x in rng.integers(0, 10**9, 200)]
    near = words[:195] + ["z"] * 5
    rows = []
    for key, w in ((b"a", words), (b"b", near)):
        m = minhash.multiset(" ".join(w), 5)
        rows.append({"side": 0, "key": key, "core": key, "sig": minhash.signatures([m], 100).astype(np.uint8).tobytes(), "units": minhash.units(*m).tobytes()})
    table = pa.Table.from_pylist(rows + [r | {"side": 1} for r in rows])
    assert {tuple(sorted(x.values())) for x in minhash._block_links(table, 0.8, 100).to_pylist()} == {(b"a", b"b")}
