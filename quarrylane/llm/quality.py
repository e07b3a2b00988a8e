"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are whole numbers or shares that numpy counts over the bytes and words of a text.  Trees
are grown on binned statistics of a bounded sample of labelled documents, then laid out as flat
arrays, which every executor walks for all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_held_out, labelled_sample, labelled_texts, shingle_hashes, slices, stored, table, tokens

#: Bound on the labelled rows that the trees are grown on.
MOST_LABELLED = 20_000
STATISTICS = (
    "bytes words lines mean_word longest_word upper digit punctuation symbol exclamation bar non_ascii distinct_words top_word adjacent_equal repeated_lines "
    "short_words capital_words line_words ends_sentence symbol_words longest_repeat"
).split()


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text; nulls count as empty, all of an empty text's are 0."""
    t = tokens(texts)
    n = len(t.bounds) - 1
    out = np.zeros((n, len(STATISTICS)))
    raw = t.raw
    size = np.diff(t.offsets)
    words = np.diff(t.bounds)

    def share(mark: np.ndarray, per=size) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mark)])
        at = t.offsets if len(mark) == len(raw) and per is size else t.bounds
        return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, per)

    letter = ((raw | 0x20) >= 97) & ((raw | 0x20) <= 122)
    length = t.ends - t.starts
    first, last = raw[t.starts] if len(raw) else raw, raw[t.ends - 1] if len(raw) else raw
    symbols = np.zeros(256, bool)
    symbols[list(b"#$%&*+/<=>@[]^_`{}~\\")] = True
    newline = raw == 10
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(words)
    out[:, 2] = share(newline) * size / np.maximum(1, words)
    out[:, 3] = share(length, words)
    out[:, 5] = share((raw >= 65) & (raw <= 90))
    out[:, 6] = share((raw >= 48) & (raw <= 57))
    out[:, 7] = share((raw > 32) & (raw < 127) & ~letter & ~((raw >= 48) & (raw <= 57)))
    out[:, 8] = share(symbols[raw])
    out[:, 9] = share(raw == 33)
    out[:, 10] = share(raw == 124)
    out[:, 11] = share(raw > 127)
    out[:, 16] = share(length <= 3, words)
    out[:, 17] = share((first >= 65) & (first <= 90), words)
    out[:, 18] = words / np.maximum(1, share(newline) * size + 1)
    out[:, 19] = share((last == 46) | (last == 63), words)
    out[:, 20] = share(symbols[last], words)
    same = np.zeros(len(t.hashes), bool)
    same[1:] = t.hashes[1:] == t.hashes[:-1]
    same[t.bounds[:-1][words > 0]] = False
    out[:, 14] = share(same, words)
    of = np.repeat(np.arange(n), words)
    order = np.lexsort((t.hashes, of))
    new = np.ones(len(order), bool)
    new[1:] = (t.hashes[order][1:] != t.hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(order)))
    out[:, 12] = np.bincount(of[order][at], minlength=n) / np.maximum(1, words)
    np.maximum.at(out[:, 13], of[order][at], count)
    out[:, 13] /= np.maximum(1, words)
    np.maximum.at(out[:, 4], of, length)
    # Repeated blocks: the share of words whose next eight words occur before in the text.
    if len(t.hashes) > 8:
        s = shingle_hashes(t.hashes, 8)
        o = of[: len(s)]
        whole = np.arange(len(s)) + 8 <= t.bounds[o + 1]
        s, o = s[whole], o[whole]
        k = np.lexsort((s, o))
        again = np.zeros(len(k), bool)
        again[1:] = (s[k][1:] == s[k][:-1]) & (o[k][1:] == o[k][:-1])
        out[:, 21] = np.bincount(o[k][again], minlength=n) / np.maximum(1, words)
    # Lines that occur before in the text.
    line = np.concatenate([[0], np.cumsum(newline)])[t.starts] if len(raw) else np.zeros(0, np.int64)
    if len(line):
        begin = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (of[1:] != of[:-1])])
        place = (np.arange(len(line)) - np.repeat(begin, np.diff(np.append(begin, len(line))))).astype(np.uint64)
        h = np.add.reduceat(t.hashes * (place * np.uint64(2) + np.uint64(1)), begin)
        o = of[begin]
        k = np.lexsort((h, o))
        again = np.zeros(len(k), bool)
        again[1:] = (h[k][1:] == h[k][:-1]) & (o[k][1:] == o[k][:-1])
        out[:, 15] = np.bincount(o[k][again], minlength=n) / np.maximum(1, np.bincount(o, minlength=n))
    return out


class Trees:
    """Boosted trees as flat arrays: node i asks whether statistic[i] is at most limit[i] and goes to
    left[i] or left[i] + 1; leaves point at themselves and hold a value."""

    def __init__(self, offset: float):
        self.offset = offset
        self.statistic, self.limit, self.left, self.value = ([] for _ in range(4))
        self.roots: list[int] = []
        self.depth = 1

    def flat(self) -> Trees:
        self.statistic, self.left, self.roots = (np.array(x, np.int64) for x in (self.statistic, self.left, self.roots))
        self.limit, self.value = np.array(self.limit, float), np.array(self.value, float)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.offset)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                inner = self.left[node] >= 0
                go = self.left[node] + (x[rows, self.statistic[node]] > self.limit[node])
                node = np.where(inner, go, node)
            out += self.value[node]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 5, l2: float = 1.0) -> Trees:
    """Grows boosted trees for the log loss of labels y (0 or 1); ties go to the first statistic and
    the lowest limit.  With one class, or no rows, the trees are empty."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(p / (1 - p))))
    model.depth = depth
    if len(y) < 2 * least or y.min() == y.max():
        return model.flat()
    limits = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(limits[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
    margin = np.full(len(y), model.offset)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = q - y, q * (1 - q)
        model.roots.append(len(model.left))
        pending = [(np.arange(len(y)), len(model.left), 0)]
        for a in (model.statistic, model.left):
            a.append(-1)
        model.limit.append(0.0), model.value.append(0.0)
        while pending:
            rows, node, level = pending.pop(0)
            g, h = grad[rows].sum(), hess[rows].sum()
            best = (1e-6, None, None)
            if level < depth and len(rows) >= 2 * least:
                for j in range(x.shape[1]):
                    if not len(limits[j]):
                        continue
                    b = binned[rows, j]
                    gs = np.cumsum(np.bincount(b, grad[rows], len(limits[j]) + 1))[:-1]
                    hs = np.cumsum(np.bincount(b, hess[rows], len(limits[j]) + 1))[:-1]
                    ns = np.cumsum(np.bincount(b, minlength=len(limits[j]) + 1))[:-1]
                    gain = gs**2 / (hs + l2) + (g - gs) ** 2 / (h - hs + l2) - g**2 / (h + l2)
                    gain[(ns < least) | (len(rows) - ns < least)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0] + 1e-12:
                        best = (gain[k], j, k)
            if best[1] is None:
                model.value[node] = -rate * g / (h + l2)
                model.statistic[node] = 0
                margin[rows] += model.value[node]
                continue
            _, j, k = best
            model.statistic[node], model.limit[node], model.left[node] = j, limits[j][k], len(model.left)
            low = binned[rows, j] <= k
            for r in (rows[low], rows[~low]):
                pending.append((r, len(model.left), level + 1))
                for a in (model.statistic, model.left):
                    a.append(-1)
                model.limit.append(0.0), model.value.append(0.0)
    return model.flat()


def quality_scores(docs: DataFrame, labelled: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text and any other columns) with `score` (replaced if there), from 0 to 1.

    labelled (doc_id, label) is a bounded table of training labels (1 good).  Null and empty texts
    have statistics of 0.  Every row is scored by itself; without labels all scores are 0.5."""
    spark = docs.sparkSession
    docs = docs.drop("score").withColumn("text", F.col("text").cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array(list(statistics(part.column(0))), pa.list_(pa.float64())), part.column(1)], ["x", "label"])

    train = labelled_texts(docs, labelled)
    rows = stored(train.mapInArrow(count, "x array<double>, label int"), "train").collect()  # one row per label at most
    x = np.array([r.x for r in rows]).reshape(len(rows), len(STATISTICS))
    y = np.array([r.label for r in rows], float)
    order = np.lexsort((*x.T, y))  # no result hangs on the order of rows
    model = spark.sparkContext.broadcast(grow(x[order], y[order], **options))
    schema = T.StructType([*docs.schema.fields]).add("score", "double")
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.value.scores(statistics(part.column(at))))], [*names, "score"])

    return docs.mapInArrow(score, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = labelled_sample(table(spark, sf_dir, "labels"), "quality", 3, 1, MOST_LABELLED)
    out = quality_scores(docs, known)
    return out.select("doc_id", crc_held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
