"""What the corpus operators share: shared-folder tables, row identity, word hashing, numpy mixing."""

from __future__ import annotations

import functools
import re
import tempfile
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch that goes to Python: whole texts may be long, so batches are short.
ARROW_ROWS = 1000
#: Entries of one generation of a per-task word cache, so memory stays bounded.
CACHE_WORDS = 1 << 17

#: Combining marks, as ranges of a character class; they belong to the word of the letter before them.
_MARKS = "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in ([c] for c in [*range(0x300, 0x20000), *range(0xE0100, 0xE01F0)] if unicodedata.category(chr(c))[0] == "M"))
#: A word of letters with their marks.
WORD_OF_LETTERS = re.compile(rf"[^\W\d_]+(?:[{_MARKS}]+[^\W\d_]*)*")

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset (local tests) a folder of this session's own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="kalendry-")
    return _own[app]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes the frame once as Parquet in the shared folder and reads it back.

    What the frame was made from is not needed any more, so the driver is asked to let go of it: shuffle files of
    finished steps are then deleted, and disk holds those of one step at a time.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the bitmap of perhaps() (a multiple of 32,768; 8 MB).
SLOTS = 1 << 26


def perhaps(held: DataFrame, key, asked: DataFrame) -> DataFrame:
    """The rows of held whose key (a 64-bit hash) the only column of asked may have: all that it has, and few others.

    An exact inner join must follow; texts that nothing asks for are then not shuffled. (A semi-join would be done first.)
    """
    slot = lambda c: F.pmod(c, F.lit(SLOTS))
    bits = asked.select((slot(F.col(asked.columns[0])) + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(slot(key), 3) % 4096 + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    met = held.withColumn("bucket", F.shiftright(slot(key), 15) + 1).join(F.broadcast(bits), "bucket")
    return met.where(F.getbit(byte, (slot(key) % 8).cast("int")) == 1).select(*held.columns)


def row_key():
    """64 bits that identify a row by (doc_id, text): rows that agree in both are one document listed twice."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def id_and_text(docs: DataFrame, *more) -> DataFrame:
    """Only what an operator needs, so that clashing extra columns never get in the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def spot(column: str, seed: int):
    """A number from 0 to 1 that a column's hash fixes, in 63 bits: any share of rows, however small, can be drawn by it."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 1) / F.lit(2.0**63)


def one_text_each(docs: DataFrame, label: str) -> DataFrame:
    """doc_id, label, text: one row for each doc_id however often it is listed, with the greatest of its texts."""
    return docs.groupBy("doc_id").agg(F.max(label).alias(label), F.max("text").alias("text"))


def carried(docs: DataFrame):
    """All columns of docs but text, as one struct `others`: whatever their names, they clash with nothing.

    restored() turns a frame that has `others` and `text` back into the columns of docs.
    """
    return F.struct(*[F.col(quoted(c)) for c in docs.columns if c != "text"]).alias("others")


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col("text") if c == "text" else F.col(f"others.{quoted(c)}") for c in docs.columns])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table_of(rows: list[tuple], names: list[str], types: list | None = None) -> pa.RecordBatch:
    """Rows as a batch; all columns are longs unless types says otherwise."""
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types or [pa.int64()] * len(names), strict=True)], names=names)


def crc_fold(modulus: int):
    """crc32 of the decimal doc_id, modulo; null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


class Cache(dict):
    """word -> make(word), in two generations: a full one becomes the old one, and words found there come back."""

    def __init__(self, make, size: int = CACHE_WORDS):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, word):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        self[word] = out
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer on uint64, vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random odd number, its powers and those of its inverse, and a random number for each byte.
_STEP = 0x9E3779B97F4A7C15
_SPAN = 1 << 20
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BLANK = np.isin(np.arange(256), [*b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "])
_OTHER_BLANK = re.compile(r"[^\S ]")


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of its inverse (64 bits), for a stretch of _SPAN bytes."""
    out = []
    for base in (_STEP, pow(_STEP, -1, 1 << 64)):
        x = np.full(_SPAN + 1, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _lowered(text: str | None) -> bytes:
    text = (text or "").lower()
    if not text.isascii():
        text = _OTHER_BLANK.sub(" ", text)
    return text.encode("utf-8", "surrogatepass")


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text of _lowered() starts, and a 64-bit hash of it, all words at once.

    A word's hash is a polynomial in its bytes, taken from prefix sums over the text and mixed.
    """
    raw = np.frombuffer(text, np.uint8)
    power, inverse = _powers()
    starts, out, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while at < len(raw):
        part = raw[at : at + _SPAN]
        blank = _BLANK[part]
        if at + _SPAN <= len(raw):  # up to the last blank
            cut = np.nonzero(blank)[0]
            if not len(cut):  # a word of that length is hashed whole
                rest = np.nonzero(_BLANK[raw[at:]])[0]
                word = raw[at : at + rest[0]] if len(rest) else raw[at:]
                starts.append(np.array([at]))
                out.append(mix(np.array([xxhash.xxh3_64_intdigest(word.tobytes())], np.uint64)))
                at += len(word)
                continue
            part, blank = part[: cut[-1] + 1], blank[: cut[-1] + 1]
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * power[: len(part)], out=total[1:])
        starts.append(start + at)
        out.append(mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)))
        at += len(part)
    return np.concatenate(starts), np.concatenate(out)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word of a text (lower case, split at white space)."""
    return _words(_lowered(text))[1]


def word_hashes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() of many texts end to end, and the number of words of each."""
    raw = [_lowered(t) for t in texts]
    starts, out = _words(b"\n".join(raw))
    edges = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return out, np.diff(np.searchsorted(starts, edges))


def parts_of(texts: list[str | None], size: int = 1 << 21):
    """(from, to) of stretches of a list of texts with about `size` characters, one text at least."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t or "") > size:
            yield first, i
            first, total = i, 0
        total += len(t or "")
    if texts:
        yield first, len(texts)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive words; of all words where there are fewer (none for none)."""
    n = min(n, len(words))
    if not n:
        return np.empty(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        out = (out ^ words[j : len(words) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)
