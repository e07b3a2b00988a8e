"""Helpers shared by the text operators: tables, shared storage, Arrow batches, word hashes.

Word hashes are 64 bit.  A word is the longest run of bytes that are not separators, so it
is the same in UTF-8 as in code points when all separators are ASCII.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = b" \t\n\x0b\x0c\r"
NOT_ALNUM = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where none is set, a temporary one of this machine, on a local
    master only (tests); on a cluster that would lose what other machines write, so it fails there."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and a
    lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quarrylane-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def broadcasts(spark: SparkSession) -> Iterator[Callable[[Any], Broadcast]]:
    """Broadcasts of bounded values that are destroyed at the end, when all that reads them is stored."""
    made: list[Broadcast] = []

    def share(value: Any) -> Broadcast:
        made.append(spark.sparkContext.broadcast(value))
        return made[-1]

    try:
        yield share
    finally:
        for b in made:
            b.destroy()


def train_rows(key: Column, mod: int, held_out: int) -> Column:
    """True where crc32 of the id, as text, leaves another remainder; a null id is held out."""
    return F.coalesce(F.crc32(key.cast("string")) % mod != held_out, F.lit(False))


def crc_held_out(key: Column, mod: int, held_out: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % mod == held_out, F.lit(True))


def slices(batch: pa.RecordBatch, column: int, most: int = 4 * BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch by rows so that the texts of each part hold about `most` bytes."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.cumsum(byte_lengths(batch.column(column)))
    a = 0
    while a < n:
        done = sizes[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(a, b - a)
        a = b


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False), dtype=np.int64)


def _rule(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64, n, dtype=np.uint64) | np.uint64(1)


_BYTE = _rule(11, 256)
_ROOT = 0x9E3779B97F4A7C15
_ROOT_INVERSE = pow(_ROOT, -1, 2**64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max([1 << max(12, int(n).bit_length()), *_powers])
    if size not in _powers:
        _powers.clear()
        up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)
        a, b = _ROOT, _ROOT_INVERSE
        while len(up) < size:
            up, down = np.concatenate([up, up * np.uint64(a)]), np.concatenate([down, down * np.uint64(b)])
            a, b = a * a % 2**64, b * b % 2**64
        _powers[size] = up, down
    return _powers[size]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Tokens:
    """Words of some texts, one after another; the words of text i are bounds[i]:bounds[i+1].

    starts and ends are byte places in raw, where text i begins at offsets[i]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    raw: np.ndarray
    offsets: np.ndarray
    stems: np.ndarray | None = None


def tokens(texts: pa.Array, separators: bytes = SPACES, stem: int = 0) -> Tokens:
    """Words and word hashes of all texts, with A-Z lower-cased. Nulls count as empty.
    With `stem`, also hashes of the first so many bytes of each word (all of a shorter one).

    Works in blocks of BLOCK_BYTES, cut between texts or at a separator, so memory follows the
    longest word, not the longest text."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[int(at[0]) : int(at[-1])]
    at = at - at[0]
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    word = is_word[low[data]]
    first = np.zeros(len(data) + 1, bool)
    first[at[:-1]] = True
    left = word.copy()
    left[1:] &= ~word[:-1] | first[1:-1]
    right = word.copy()
    right[:-1] &= ~word[1:] | first[1:-1]
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    hashes = np.empty(len(starts), np.uint64)
    stems = np.empty(len(starts), np.uint64) if stem else None
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _power_tables(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[low[data[a:b]]] * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        hashes[i:j] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        if stem:
            e = np.minimum(e, s + stem)
            stems[i:j] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return Tokens(hashes, starts, ends, np.searchsorted(starts, at), data, at, stems)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; of the whole sequence when it is shorter; none of none."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = mixed(words[:n])
    for k in range(1, size):
        out = mixed(out * np.uint64(0x9FB21C651E98DF25) + words[k : k + n])
    return out


def labelled_sample(labels: DataFrame, name: str, mod: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, label): at most `most` labelled documents whose crc32 remainder is not held_out, taken
    in the order of a hash of the id; a label is 1 or (any other number) 0; a document labelled twice
    has its larger one."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(name).cast("int") == 1).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    one = one.where(train_rows(F.col("doc_id"), mod, held_out)).groupBy("doc_id").agg(F.max("label").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_texts(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(text, label): one text for each id of labelled (doc_id, label; bounded) that docs (doc_id, text) has,
    so at most as many rows however often an id repeats; of several texts the one with the least hash.
    Null texts count as empty."""
    known = F.broadcast(labelled.select(F.col("doc_id").alias("_id"), "label"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", text.alias("text")).join(known, F.col("doc_id") == F.col("_id"))
    return own.groupBy("_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).select("text", "label")


class BloomBits:
    """A Bloom filter of 2**log_bits bits, the same size for any input (its broadcast is bounded)."""

    def __init__(self, bits: np.ndarray, hashes: int):
        self.bits, self.hashes, self.mask = bits, hashes, np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def places(keys: np.ndarray, hashes: int, mask: np.uint64, left: list[np.ndarray] | None = None) -> Iterator[np.ndarray]:
        """The places of all keys, hash by hash; only those of left[0], which the reader may narrow."""
        step = mixed(keys + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
        for i in range(hashes):
            at = left[0] if left else slice(None)
            yield (keys[at] + np.uint64(i) * step[at]) & mask

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        left = [np.arange(len(keys))]
        for p in self.places(mixed(keys), self.hashes, self.mask, left):
            left[0] = left[0][(self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        left = left[0]
        out = np.zeros(len(keys), bool)
        out[left] = True
        return out


SEGMENT_BITS = 1 << 19


def build_bloom(keys: DataFrame, column: str, log_bits: int, hashes: int, levels: str | None = None) -> BloomBits:
    """The filter of all keys (64-bit longs) of a table, built segment by segment on the executors;
    only its 2**log_bits bits come to the driver. With `levels`, a key is entered once per level 1..n."""
    mask = np.uint64((1 << log_bits) - 1)
    segments = max(1, (1 << log_bits) // SEGMENT_BITS)
    size = min(SEGMENT_BITS, 1 << log_bits)

    def scatter(batches):
        whole = np.zeros((1 << log_bits) // 8, np.uint8)
        used = False
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if levels:
                q = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                k = level_keys(np.repeat(k, q), np.concatenate([np.arange(1, x + 1) for x in q]) if len(q) else q)
            for p in BloomBits.places(mixed(k), hashes, mask):
                np.bitwise_or.at(whole, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
            used |= len(k) > 0
        if used:
            parts = whole.reshape(segments, -1)
            full = np.flatnonzero(parts.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in full], pa.binary())], ["segment", "bits"])

    def merge(key, t):
        out = np.zeros(size // 8, np.uint8)
        for x in t.column("bits"):
            out |= np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    cols = [F.col(column).cast("long")] + ([F.col(levels).cast("int")] if levels else [])
    got = keys.select(*cols).mapInArrow(scatter, "segment int, bits binary").groupBy("segment").applyInArrow(merge, "segment int, bits binary")
    bits = np.zeros((1 << log_bits) // 8, np.uint8)
    for r in got.collect():  # bounded: the filter itself
        bits[r.segment * (size // 8) : (r.segment + 1) * (size // 8)] = np.frombuffer(bytes(r.bits), np.uint8)
    return BloomBits(bits, hashes)


def level_keys(keys: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """The key that stands for 'this n-gram has at least that level'."""
    return mixed(keys + np.asarray(level).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(rb"[^\x20\x09-\x0D]+")
