"""Operator 10 on near passages that are made of lines which earlier documents hold."""

import random

import pytest

from kalendry.llm import substring


@pytest.mark.parametrize("holders", [2, 8])
def test_near_passages_of_frequent_lines(spark, make_docs, holders):
    rng = random.Random(holders)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]
    lines = [(words(26), words(26)) for _ in range(120)]
    texts = [" ".join(words(40) + line + words(40)) for _ in range(holders) for pair in lines for line in pair]
    first = len(texts)
    texts += [" ".join(words(60) + a + b + words(60)) for a, b in lines]
    second = len(texts)
    for a, b in lines:
        passage = a + b
        passage[rng.randrange(10, 42)] = "changed"
        texts.append(" ".join(words(60) + passage + words(60)))
    found = {(r.doc_b, r.doc_a) for r in substring.repeats(make_docs(texts)).collect() if r.end_b - r.start_b >= 50}
    hit = sum((second + i, first + i) in found for i in range(120))
    print("found", hit)
    assert hit >= 0.95 * 120  # likeness 43/53
