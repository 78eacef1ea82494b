"""Every stage of the pipeline against a plain version of what it is to do, on the stage's own input."""

from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from kalendry.llm import queries
from kalendry.llm.common import materialize

SF = "/root/testdata/sf0.001"


def _grams(text, n):
    words = (text or "").lower().split()
    n = min(n, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def _near_classes(texts):
    """Least doc_id of every document's class, from all pairs."""
    bags = {i: Counter(_grams(t, 5)) for i, t in texts.items()}
    size = {i: sum(b.values()) for i, b in bags.items()}
    root = {i: i for i in texts}

    def find(i):
        return i if root[i] == i else find(root[i])

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if size[i] and size[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]):
                both = sum((bags[i] & bags[j]).values())
                if both >= 0.8 * (size[i] + size[j] - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: find(i) for i in ids}


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(materialize(stage(spark, kept[-1], SF), "test-" + name.replace(" ", "-")))
        assert kept[-1].columns == docs.columns and dict(kept[-1].dtypes) == dict(docs.dtypes)
    texts = [{r.doc_id: r.text for r in k.collect()} for k in kept]

    toxic = {r.doc_id for r in queries.op9_toxicity(spark, SF).where("toxic = 1").collect()}
    assert toxic and set(texts[1]) == set(texts[0]) - toxic
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(i in texts[2]) == bool(labels[i]) for i in texts[1] if labels.get(i) is not None]
    assert set(texts[2]) < set(texts[1]) and sum(judged) > 0.9 * len(judged)

    assert set(texts[3]) == set(_near_classes(texts[2]).values())
    assert all(texts[3][i] == texts[2][i] for i in texts[3])

    assert set(texts[4]) == set(texts[3])
    holders = defaultdict(set)
    for i, t in texts[4].items():
        for g in _grams(t, 50):
            holders[g].add(i)
    assert not [g for g, who in holders.items() if len(g) == 50 and len(who) > 1]
    shared = Counter(g for t in texts[3].values() for g in set(_grams(t, 5)))
    for i, t in texts[3].items():
        if all(shared[g] == 1 for g in _grams(t, 5)):
            assert texts[4][i] == t

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).collect():
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts[4])
    for i, t in texts[4].items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(library.encode(t or "", add_special_tokens=False).ids) + 1
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
