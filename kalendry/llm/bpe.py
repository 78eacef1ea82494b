"""Operator 7: BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word the last token of its encoding is unique. It is found among the vocabulary
entries that are suffixes of that prefix, which an automaton with suffix links (Aho-Corasick over the
vocabulary) lists in one pass over the word: a suffix is the last token if it is compatible with the last
token of the prefix before it, that is, if the two stay apart when their concatenation is encoded. The
test undoes merges on both sides of the seam and looks whether an earlier merge would have crossed it.
Back-pointers from the whole word then give the exact ids, in time linear in the length of the word.

Text is prepared as the vocabulary file says (composed form, white space dropped, lower case, split into
contractions, letters, single digits and other runs), word by word, with a bounded cache of words. Strings
of special tokens in a text become those tokens, as in the tokenizers library.

Defined cases: a null text counts as empty: no ids, and the empty text when decoded. Rows are independent,
so repeated ids and rows are kept as they are; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import json

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kalendry.llm.common import Cache, id_and_text, prepare

END = "</w>"
#: Entries of one generation of each cache: runs of text between white space are more than words, and a run that was dropped costs its encoding.
KEPT_RUNS = 1 << 18
#: Fixed: how the library spells bytes as letters (printable Latin-1 stays, the rest follow from 256 on).
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELL = {b: chr(b) for b in _KEPT} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _KEPT)}
#: Fixed: white space as the vocabulary file's \\s has it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


class Vocabulary:
    """Merge rules and automaton of a vocabulary file in the tokenizers library's BPE format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.end = model.get("end_of_word_suffix") or ""
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, id)
        self.parts: dict[int, tuple[int, int, int]] = {}  # id -> (rank, left, right)
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right, both = self.ids[a], self.ids[b], self.ids[(a[: -len(self.end)] if self.end and a.endswith(self.end) else a) + b]
            self.merged.setdefault((left, right), (rank, both))
            self.parts.setdefault(both, (rank, left, right))
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if i in self.special.values():
                continue
            ended = bool(self.end) and token.endswith(self.end)
            body = token[: -len(self.end)] + "\0" if ended else token
            if i not in self.parts or self.apart(self.parts[i][1], self.parts[i][2], self.parts[i][0]):
                self.automaton.add_word(body, (len(body), i))
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}

    def apart(self, left: int, right: int, limit: int | None = None) -> bool:
        """Whether left and right stay two tokens: no merge crosses their seam before it is closed by others.

        limit: only merges of a lower rank count (for a token's own halves: those before their own merge).
        """
        most = len(self.merged) if limit is None else limit
        while True:
            crossing = self.merged.get((left, right))
            if crossing and crossing[0] < most:
                return False
            # step back to just before the later of the two tokens was made; of equals, the right one is later
            x, y = self.parts.get(left), self.parts.get(right)
            if x is None and y is None:
                return True
            if y is None or (x is not None and x[0] > y[0]):
                most, left = min(most, x[0]), x[2]
            else:
                most, right = min(most, y[0] + 1), y[1]

    def word(self, spelled: str) -> list[int]:
        """Ids of one word, spelled in the library's letters."""
        text = spelled + "\0" if self.end else spelled
        n = len(text)
        tokens, sizes = [-1] * (n + 1), [0] * (n + 1)  # of the last token of each prefix
        tokens[0] = -2
        known = self.known.get
        at = 0
        for end, (size, token) in self.automaton.iter(text):
            if end < at:
                continue  # this prefix has its token
            before = tokens[end + 1 - size]
            if before == -1:
                continue
            if before >= 0:
                fits = known(before << 20 | token)
                if fits is None:
                    fits = self._remember(before, token)
                if not fits:
                    continue
            at = end + 1
            tokens[at], sizes[at] = token, size
        out, at = [], n
        while at:
            if tokens[at] < 0:
                raise ValueError(f"the vocabulary cannot spell {spelled!r}")
            out.append(tokens[at])
            at -= sizes[at]
        return out[::-1]

    def _remember(self, left: int, right: int) -> bool:
        if len(self.known) > 300_000:
            self.known.clear()
        fits = self.known[left << 20 | right] = self.apart(left, right)
        return fits


class Codec:
    """Whole texts to ids and back, as the tokenizers library does with a lower-case word vocabulary.

    Composing, lower case and splitting of anything but ASCII are the library's own, from the file's settings, as its
    character tables are of another edition than Python's; the ids come from Vocabulary.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.vocabulary = v = Vocabulary(path)
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
        self.special = regex.compile("|".join(regex.escape(s) for s in v.special)) if v.special else None
        self.odd = regex.compile(r"[\x1c-\x1f]")
        self.space = regex.compile(f"[{_SPACE}]+")
        self.words = Cache(v.word, KEPT_RUNS)
        self.chunks = Cache(self._chunk, KEPT_RUNS)

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, the ids and their tokens as text, of a run of text without white space."""
        if chunk.isascii() and chunk.isprintable():
            pieces = self.pieces.findall(chunk.lower())
        else:
            pieces = [p for p, _ in self.split(self.normal(chunk))]
        ids = [i for w in pieces for i in self.words[w]]
        return len(ids), " ".join(map(str, ids)), " ".join(map(self.vocabulary.tokens.__getitem__, ids))

    def _plain(self, text: str) -> list[tuple[int, str, str]]:
        chunks = self.space.split(text) if self.odd.search(text) else text.split()
        return [x for x in map(self.chunks.__getitem__, chunks) if x[0]]

    def encode(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by a space, decoded text)."""
        if self.special is None or not (found := list(self.special.finditer(text))):
            parts = self._plain(text)
        else:
            parts, at = [], 0
            for m in found:
                parts += self._plain(text[at : m.start()])
                parts.append((1, str(self.vocabulary.special[m[0]]), m[0]))
                at = m.end()
            parts += self._plain(text[at:])
        return sum(x[0] for x in parts), " ".join([x[1] for x in parts]), " ".join([x[2] for x in parts])

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False) for a file without a decoder."""
        return " ".join(self.vocabulary.tokens[i] for i in ids if i in self.vocabulary.tokens)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each Python worker: tables and word cache outlive a task."""
    return Codec(path)


def _encoded(batches, path: str, digests: bool):
    encode = codec(path).encode
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        rows = [encode(t or "") for t in batch.column("text").to_pylist()]
        if digests:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([sha(r[1]) for r in rows], pa.string()), pa.array([sha(r[2]) for r in rows], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        else:
            ids = [list(map(int, r[1].split())) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded: one row for each document."""
    prepare(docs.sparkSession)
    return id_and_text(docs).mapInArrow(lambda it: _encoded(it, path, False), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() without moving the ids out of the task."""
    prepare(docs.sparkSession)
    return id_and_text(docs).mapInArrow(lambda it: _encoded(it, path, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
