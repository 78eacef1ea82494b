import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kalendry.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    r = random.Random(5)
    letters = "ab thesandinger'sTL1 \n!.é"
    yield from ["", "   ", "a" * 900, "ΑΣ ΣΑΣ İstanbul", "I'd've'S don'T we'Ll", "é ẛ̣ ﬁ Å", "a\x1cb\x85c\xa0d e​f", "<|endoftext|>x<|startoftext|> <|EndOfText|>", "日本語 １２３ ⅷ", "\U0001f600\U0001f468‍\U0001f469 !!", "\x00\x01�", "_under 12345"]
    for _ in range(400):
        yield "".join(r.choice(letters) for _ in range(r.randrange(60)))
        yield "".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x370, 0x600), r.randrange(0x1E00, 0x2100), r.randrange(0x3000, 0x9FFF)])) for _ in range(r.randrange(30)))


def test_exact_ids_and_round_trip_through_the_decoder(library):
    codec = bpe.codec(PATH)
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        n, ids, decoded = codec.encode(text)
        assert (n, ids) == (len(want), " ".join(map(str, want))), text
        assert decoded == codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_every_code_point_and_random_texts_of_all_planes(library):
    codec = bpe.codec(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b" for c in points[i : i + 200]) for i in range(0, len(points), 200)]
    r = random.Random(3)
    texts += ["".join(chr(r.choice(points)) if r.random() < 0.3 else r.choice("ab 'sT1\u0301é") for _ in range(400)) for _ in range(500)]
    for text, want in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert codec.encode(text)[1] == " ".join(map(str, want.ids))


def test_query_columns(small_docs, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.digests(small_docs, PATH).join(small_docs, "doc_id").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_defined_cases(make_docs):
    docs = make_docs(["", None, (1, "a b"), (1, "a b"), (None, "q"), "word " * 40000], extra=True)
    got = {(r.doc_id, len(r.ids), r.decoded[:9]) for r in bpe.encode(docs, PATH).collect()}
    assert got == {(0, 0, ""), (1, 0, ""), (1, 2, "a</w> b</"), (None, 1, "q</w>"), (5, 40000, "word</w> ")}
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_runs_that_come_again_are_not_encoded_again():
    own, made = bpe.Codec(PATH), []
    chunk = own.chunks.make
    own.chunks.make = lambda run: made.append(run) or chunk(run)
    text = " ".join(f"w{i}" for i in range(200_000))
    first = own.encode(text)
    assert len(made) == 200_000
    assert own.encode(text) == first
    assert len(made) == 200_000  # before, 131,072 runs were the most of one generation
