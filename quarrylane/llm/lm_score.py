"""Language-model scoring with a log-frequency Bloom filter.

N-gram counts of all training documents are quantised to levels, one per factor LEVEL_BASE; an
n-gram of level q is entered q times, as (n-gram, 1) to (n-gram, q), into a Bloom filter.  A count
is read back by asking for level 1, 2, ... until one is missing, and bigram probabilities are
smoothed towards unigram ones.

All n-grams of all counts are held: the filter is cut by hash range into segments, each sized from
its own entries, and the number of segments follows the text.  Documents are dealt to chunks of
about PART_BYTES; a chunk's distinct n-grams visit their segments and the levels (and the exact
unigram counts of the base score) come back to the chunk, so nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BloomBits, crc_held_out, level_keys, mixed, slices, stored, table, tokens

LEVEL_BASE = 1.25
EXACT = 4
#: Bits an entry has at least (a segment's bits are a power of two), and hashes of an entry.
ENTRY_BITS, BLOOM_HASHES = 8, 5
#: Bytes of text for one segment of the filter, and for one chunk of documents.
PART_BYTES = 8 << 20
#: Weight of the unigrams after a word seen c times: PRIOR * c ** PRIOR_POWER, near the number of its followers.
PRIOR, PRIOR_POWER = 4.0, 0.9
#: Hashes of the marks before the first and after the last word; no word has them but by chance.
START, END = np.uint64(0x5BD1E995A5A5A5A5), np.uint64(0x1B873593C3C3C3C3)
FLUSH = 1 << 21


def with_ends(t) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, each followed by END, and where each text's tokens begin."""
    n = len(t.bounds) - 1
    at = t.bounds + np.arange(n + 1)
    out = np.empty(len(t.hashes) + n, np.uint64)
    out[at[1:] - 1] = END
    inner = np.ones(len(out), bool)
    inner[at[1:] - 1] = False
    out[inner] = t.hashes
    return out, at


def bigrams(toks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each token the hash of it and the one before (START for a text's first)."""
    before = np.empty_like(toks)
    before[1:] = toks[:-1]
    before[at[:-1]] = START
    return mixed(before * np.uint64(0x9FB21C651E98DF25) + toks)


def by_segment(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that brings the keys of each segment together, the segments that have any, and where
    each of those begins (and the last ends)."""
    at = keys.view(np.int64) % parts
    order = np.argsort(at, kind="stable")
    segments, begin = np.unique(at[order], return_index=True)
    return order, segments.astype(np.int32), np.append(begin, len(keys))


def _cells(columns: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]) -> dict[str, pa.Array]:
    """Packed values by segment, one row for each segment that any of the columns (name, values in the
    order of segments, segments, cuts) has; so rows follow the keys and not the number of segments."""
    every = np.unique(np.concatenate([c[2] for c in columns])) if columns else np.zeros(0, np.int32)
    out = {"segment": pa.array(every.astype(np.int32))}
    for name, values, segments, cuts in columns:
        row = np.searchsorted(every, segments)
        packed = [b""] * len(every)
        for r, x, y in zip(row.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            packed[r] = values[x:y].tobytes()
        out[name] = pa.array(packed, pa.binary())
    return out


def _unpacked(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def ngram_counts(docs: DataFrame, parts: int) -> DataFrame:
    """(segment, words, word_counts, pairs, pair_counts): exact counts of the uni- and bigrams of runs
    of rows of docs (doc_id, text), packed by segment; counts of several rows add up."""
    names = ["segment", "words", "word_counts", "pairs", "pair_counts"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def flush():
            if held[0]:
                cols = []
                for h, (a, b) in zip(held, (names[1:3], names[3:5])):
                    key, c = np.unique(np.concatenate(h), return_counts=True)
                    h.clear()
                    order, segments, cuts = by_segment(key, parts)
                    cols += [(a, key[order], segments, cuts), (b, c[order].astype(np.int64), segments, cuts)]
                yield pa.RecordBatch.from_pydict(_cells(cols))

        size = 0
        for batch in batches:
            for part in slices(batch, 1):
                toks, at = with_ends(tokens(part.column(1)))
                held[0].append(toks), held[1].append(bigrams(toks, at))
                size += len(toks)
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(scan, "segment int, words binary, word_counts binary, pairs binary, pair_counts binary")


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _filter(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The bits of the filter of all keys, each entered once per level 1..n."""
    size = 1 << max(10, int(ENTRY_BITS * levels.sum() - 1).bit_length())
    full = np.zeros(size, bool)
    q = 1
    while len(keys):
        for p in BloomBits.places(mixed(level_keys(keys, q)), BLOOM_HASHES, np.uint64(size - 1)):
            full[p] = True
        more = levels > q
        keys, levels, q = keys[more], levels[more], q + 1
    return np.packbits(full, bitorder="little")


def _dealt(df: DataFrame, parts: int, key: str) -> DataFrame:
    """df dealt by key to twice `parts` partitions where that is more than Spark's own number, so that
    a task holds few segments or chunks however many there are."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(2 * parts, key) if 2 * parts > n else df


def model_segments(docs: DataFrame, parts: int) -> DataFrame:
    """(segment, bits, words, counts, total): of each hash range of n-grams of docs (doc_id, text) the
    filter of all of them, the exact counts of its unigrams and their sum."""

    def build(key, t):
        words, c = _added(_unpacked(t.column("words"), np.uint64), _unpacked(t.column("word_counts"), np.int64))
        pairs, pc = _added(_unpacked(t.column("pairs"), np.uint64), _unpacked(t.column("pair_counts"), np.int64))
        bits = _filter(np.concatenate([words, pairs]), level_of(np.concatenate([c, pc])))
        row = {"segment": key[0].as_py(), "bits": bits.tobytes(), "words": words.tobytes(), "counts": c.tobytes(), "n_words": len(words), "total": int(c.sum())}
        return pa.Table.from_pylist([row], pa.schema([("segment", pa.int32()), *((n, pa.binary()) for n in ("bits", "words", "counts")), ("n_words", pa.int64()), ("total", pa.int64())]))

    return _dealt(ngram_counts(docs, parts), parts, "segment").groupBy("segment").applyInArrow(build, "segment int, bits binary, words binary, counts binary, n_words long, total long")


def level_of(c):
    """The level of a count column or array: the count itself up to EXACT, then one more for each factor LEVEL_BASE."""
    if isinstance(c, np.ndarray):
        return np.where(c <= EXACT, c, np.floor(np.log(np.maximum(c, EXACT) / EXACT) / np.log(LEVEL_BASE) + 1e-9).astype(np.int64) + EXACT)
    above = F.floor(F.log(F.col(c) / F.lit(float(EXACT))) / F.lit(float(np.log(LEVEL_BASE))) + F.lit(1e-9))
    return F.when(F.col(c) <= EXACT, F.col(c)).otherwise(above + EXACT).cast("int")


def level_counts(most: int = 140) -> np.ndarray:
    """The count that each level stands for: the middle of the whole counts that it holds; 0 for level 0."""
    lo = np.ceil(EXACT * LEVEL_BASE ** np.arange(most) - 1e-6)
    hi = np.maximum(lo, np.ceil(EXACT * LEVEL_BASE ** np.arange(1, most + 1) - 1e-6) - 1)
    return np.concatenate([np.arange(EXACT), (lo + hi) / 2])


class QuantisedCounts:
    """Counts read from a Bloom filter by asking for one level after another."""

    def __init__(self, bloom, least_level: int):
        self.bloom, self.least, self.values = bloom, least_level, level_counts()

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return self.values[self.levels(keys)]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        level = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        q = 1
        while len(left) and q < len(self.values):
            left = left[self.bloom.has(level_keys(keys[left], q))]
            level[left] = q
            q += 1
        return level


def lm_score(docs: DataFrame, held_out, prior: tuple[float, float] = (PRIOR, PRIOR_POWER)) -> DataFrame:
    """One row per row of docs (doc_id, text) with base_score (add-half unigrams, exact counts) and
    score (log10 probability by the quantised bigram model), both learnt from all rows that
    held_out (a condition) leaves.  Tokens are the words of the lower-cased text and one end.

    Null and empty texts have one token, the end.  Rows with equal ids stay apart.  Tokens are
    64-bit hashes.  With no training rows N and V are 0 and every token has log10 probability
    log10(0.5 / 0.5) = 0 in the base score.  A null id is held out by op9.  Other columns are
    ignored."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text") + F.lit(1))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    model = stored(model_segments(docs.where(~F.col("held_out")).select("doc_id", "text"), parts), "model")
    total, words = (x or 0 for x in model.agg(F.sum("total"), F.sum("n_words")).first())
    norm = total + 0.5 * (words + 1)
    chunks = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", "held_out"), F.lit(parts)).cast("int"))

    def ngrams(text: pa.Array):
        toks, at = with_ends(tokens(text))
        return toks, at, *np.unique(toks, return_inverse=True), *np.unique(bigrams(toks, at), return_inverse=True)

    def ask(key, t):
        """A chunk's distinct n-grams, packed by segment."""
        _, _, uniq, _, pairs, _ = ngrams(t.column("text").combine_chunks())
        cols = []
        for name, keys in (("words", uniq), ("pairs", pairs)):
            order, segments, cuts = by_segment(keys, parts)
            cols.append((name, keys[order], segments, cuts))
        cells = _cells(cols)
        return pa.table([cells["segment"], pa.array(np.full(len(cells["segment"]), key[0].as_py(), np.int32)), cells["words"], cells["pairs"]], ["segment", "chunk", "words", "pairs"])

    def answer(key, asks, segment):
        """The levels, and for unigrams the exact counts, of all asked n-grams of a segment."""
        out = [[], [], []]
        if asks.num_rows and segment.num_rows:
            m = QuantisedCounts(BloomBits(_unpacked(segment.column("bits"), np.uint8), BLOOM_HASHES), 1)
            known, counts = _unpacked(segment.column("words"), np.uint64), _unpacked(segment.column("counts"), np.int64)
        for words, pairs in zip(asks.column("words").to_pylist(), asks.column("pairs").to_pylist()):
            w, p = np.frombuffer(words, np.uint64), np.frombuffer(pairs, np.uint64)
            if segment.num_rows:
                c = np.zeros(len(w), np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, w), len(known) - 1)
                    c = np.where(known[place] == w, counts[place], 0)
                got = (m.levels(w), c, m.levels(p))
            else:
                got = (np.zeros(len(w)), np.zeros(len(w)), np.zeros(len(p)))
            for o, x, kind in zip(out, got, (np.uint8, np.int64, np.uint8)):
                o.append(x.astype(kind).tobytes())
        segments = pa.array(np.full(asks.num_rows, key[0].as_py() if asks.num_rows else 0, np.int32))
        return pa.table([segments, asks.column("chunk").cast(pa.int32()), *(pa.array(o, pa.binary()) for o in out)], ["segment", "chunk", "levels", "counts", "pair_levels"])

    def score(key, t, answers):
        """The documents of a chunk with both scores."""
        answers = answers.sort_by("segment")
        values = level_counts()
        toks, at, uniq, inv, pairs, pinv = ngrams(t.column("text").combine_chunks())

        def back(keys, column, kind):
            out = np.empty(len(keys), kind)
            out[by_segment(keys, parts)[0]] = _unpacked(answers.column(column), kind)
            return out

        sums = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  every text has its end
        c = back(uniq, "counts", np.int64)
        base = np.log10((c + 0.5) / norm)[inv]
        # The model.
        levels = values[back(uniq, "levels", np.uint8)]
        uni = levels[inv]
        before = np.empty_like(uni)
        before[1:] = uni[:-1]
        before[at[:-1]] = levels[np.searchsorted(uniq, END)]
        both = np.minimum(values[back(pairs, "pair_levels", np.uint8)][pinv], np.minimum(before, uni))
        p1 = (uni + 0.5) / norm
        weight = np.maximum(1.0, prior[0] * before ** prior[1])
        logs = np.log10((both + weight * p1) / (before + weight))
        return pa.table(
            [t.column("doc_id"), t.column("held_out"), pa.array(np.diff(at)), pa.array(sums((c > 0)[inv].astype(np.int64))), pa.array(np.full(t.num_rows, total, np.int64)), pa.array(sums(base)), pa.array(sums(logs))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    chunks = _dealt(chunks, parts, "chunk")
    asks = chunks.groupBy("chunk").applyInArrow(ask, "segment int, chunk int, words binary, pairs binary")
    answers = _dealt(asks, parts, "segment").groupBy("segment").cogroup(_dealt(model.select("segment", "bits", "words", "counts"), parts, "segment").groupBy("segment")).applyInArrow(answer, "segment int, chunk int, levels binary, counts binary, pair_levels binary")
    return chunks.groupBy("chunk").cogroup(_dealt(answers, parts, "chunk").groupBy("chunk")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score(docs, crc_held_out(docs["doc_id"], 5, 1))
