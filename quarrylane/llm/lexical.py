"""Ranked lexical search: MaxScore over shards of an inverted index, with bounds on pairs of terms.

Documents are cut into shards of some megabytes, each an inverted list of its own in one row.
For the terms of a block of items, the largest impact of each term and the largest joint impact of
each pair of neighbouring terms (an item's terms stand by falling weight) are gathered over the
documents in which both occur.  An item's terms from the i-th on then add at most

    bound[i] = min(single[i] + bound[i + 1], pair[i, i + 1] + bound[i + 2])

which is far below the sum of single maxima where rare terms seldom meet.  Terms whose bound is
below the score of the k-th document found so far only add to documents found by the terms before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import NOT_ALNUM, broadcasts, slices, stored, table, tokens

TOP = 50
#: Bytes of text in a shard (one text at least).
SHARD_BYTES = 8 << 20
#: Terms of the items that are searched at once (one item at least), repeats between items counted, and pairs
#: whose lists are gathered at once; they bound what is broadcast and what a task holds.
BLOCK_TERMS, BLOCK_PAIRS = 1 << 16, 1 << 16
#: Steps of the histogram of impacts from which the first thresholds follow.
STEPS = 64
SCALE = 1_000_000
SHARD = "doc_ids array<bigint>, n_docs bigint, n_words bigint, words binary, terms binary, starts binary, docs binary, counts binary"


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard of docs (doc_id, text), made without a shuffle: the ids of its documents that have a
    term, their numbers of words, and for each term (64-bit hash, ascending) the documents (places in the
    shard) that hold it and how often.  Null texts and texts without terms are left out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, shard_bytes):
                t = tokens(part.column(1), NOT_ALNUM)
                sizes = np.diff(t.bounds)
                own = np.flatnonzero(sizes)
                doc = np.repeat(np.arange(len(own), dtype=np.int32), sizes[own])
                order = np.argsort(t.hashes, kind="stable")
                term, doc = t.hashes[order], doc[order]
                new = np.ones(len(term), bool)
                new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                counts = np.diff(at, append=len(term)).astype(np.int32)
                term, doc = term[at], doc[at]
                first = np.ones(len(term), bool)
                first[1:] = term[1:] != term[:-1]
                starts = np.append(np.flatnonzero(first), len(term)).astype(np.int32)
                cells = [x.tobytes() for x in (sizes[own].astype(np.int64), term[first], starts, doc, counts)]
                ids = part.column(0).take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([len(own)], pa.int64()), pa.array([int(sizes.sum())], pa.int64())] + [pa.array([c], pa.binary()) for c in cells],
                    names=["doc_ids", "n_docs", "n_words", "words", "terms", "starts", "docs", "counts"],
                )

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(scan, SHARD)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct term hashes of each row of items (item_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = tokens(batch.column(1), NOT_ALNUM)
            own = [np.unique(t.hashes[a:b]).view(np.int64).tolist() for a, b in zip(t.bounds[:-1], t.bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["item_id", "terms"])

    return items.select(items["item_id"].cast("long"), items["text"].cast("string")).mapInArrow(scan, "item_id long, terms array<bigint>")


def _blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Items in blocks of about so many terms; the driver holds one block and one partition of items."""
    block: list[tuple[int | None, np.ndarray]] = []
    n = 0
    for r in items.where("size(terms) > 0").toLocalIterator():
        block.append((r.item_id, np.array(r.terms, np.int64).view(np.uint64)))
        n += len(r.terms)
        if n >= block_terms:
            yield block
            block, n = [], 0
    if block:
        yield block


@dataclass
class Shard:
    """A row of the index, restricted to a vocabulary: the postings of its term v are at[v]:end[v]."""

    doc_ids: pa.Array
    words: np.ndarray
    docs: np.ndarray
    counts: np.ndarray
    at: np.ndarray
    end: np.ndarray

    @staticmethod
    def rows(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[Shard]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)  # noqa: B023, E731
                terms, starts = cell("terms", np.uint64), cell("starts", np.int32)
                if not len(terms):
                    continue
                p = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
                here = terms[p] == vocabulary
                at = np.where(here, starts[p], 0)
                yield Shard(batch.column("doc_ids")[i].values, cell("words", np.int64), cell("docs", np.int32), cell("counts", np.int32), at, np.where(here, starts[p + 1], at))


@dataclass
class Model:
    """Counts of the collection and weights of a block's terms."""

    n_docs: int
    n_words: int
    weights: np.ndarray

    def lengths(self, words: np.ndarray) -> np.ndarray:
        """The m of documents with so many words, exactly also beyond 64 bits."""
        if len(words) and 50 * int(words.max()) * self.n_docs >= 1 << 63:
            return np.array([50 + 50 * int(n) * self.n_docs // self.n_words for n in words], np.int64)
        return 50 + 50 * words * self.n_docs // self.n_words

    def impacts(self, term: int, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        tf = counts.astype(np.int64)
        return self.weights[term] * (1000 * SCALE * tf // (1000 * tf + 20 * lengths))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def document_counts(index: DataFrame, vocabulary, n: int) -> np.ndarray:
    """The documents that hold each of n terms; n numbers come to the driver."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n, np.int64)
        for s in Shard.rows(batches, vocabulary.value):
            df += s.end - s.at
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(n, np.int64)
    for r in index.select("doc_ids", "words", "terms", "starts", "docs", "counts").mapInArrow(scan, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def _highest(model: Model, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.where(first == second, model.weights[first], model.weights[first] + model.weights[second]) * SCALE


def pair_lists(index: DataFrame, vocabulary, model: Model, first: np.ndarray, second: np.ndarray) -> DataFrame:
    """(pair, step, n, most) of the term pairs first[i], second[i] (equal: the single term): of the documents
    that hold both, how many have a joint impact in each STEPS-th of the largest thinkable, and at least the
    largest in it.  Rows are counted in the tasks first, so the shuffle follows pairs and tasks, not documents."""
    highest = _highest(model, first, second)
    order = np.argsort(first, kind="stable")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most = np.zeros((len(first), STEPS), np.int64), np.zeros(len(first), np.int64)
        for s in Shard.rows(batches, vocabulary.value):
            lengths = model.lengths(s.words)
            known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

            def term(v: int) -> tuple[np.ndarray, np.ndarray]:
                if v not in known:
                    docs = s.docs[s.at[v] : s.end[v]]  # noqa: B023
                    known[v] = docs, model.impacts(v, s.counts[s.at[v] : s.end[v]], lengths[docs])  # noqa: B023
                return known[v]

            spread, marked = np.zeros(len(s.words), np.int64), -1
            for i in order:
                a, b = int(first[i]), int(second[i])
                if s.at[a] == s.end[a] or s.at[b] == s.end[b] or not highest[i]:
                    continue
                if a == b:
                    joint = term(a)[1]
                else:
                    if marked != a:
                        if marked >= 0:
                            spread[term(marked)[0]] = 0
                        docs, own = term(a)
                        spread[docs], marked = own, a
                    docs, own = term(b)
                    other = spread[docs]
                    joint = (own + other)[other > 0]
                if len(joint):
                    n[i] += np.bincount(np.minimum(joint * STEPS // highest[i], STEPS - 1), minlength=STEPS)
                    most[i] = max(most[i], joint.max())
        pair, step = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(n[pair, step]), pa.array(most[pair])], names=["pair", "step", "n", "most"])

    return index.mapInArrow(scan, "pair int, step int, n long, most long").groupBy("pair", "step").agg(F.sum("n").alias("n"), F.max("most").alias("most"))


@dataclass
class Plan:
    """A block of items made ready: terms by falling weight, bounds of terms and neighbours, thresholds."""

    item_ids: list[int | None]
    terms: list[np.ndarray]
    single: list[np.ndarray]
    joint: list[np.ndarray]
    least: list[int]


def plan_block(block: list[tuple[int | None, np.ndarray]], index: DataFrame, vocabulary, model: Model, k: int) -> Plan:
    terms = []
    for _, own in block:
        v = np.searchsorted(vocabulary.value, own)
        v = v[model.weights[v] > 0]
        terms.append(v[np.argsort(-model.weights[v], kind="stable")])
    pairs = {(int(a), int(a)): 0 for v in terms for a in v} | {(int(a), int(b)): 0 for v in terms for a, b in zip(v[:-1], v[1:])}
    pairs = {p: i for i, p in enumerate(pairs)}
    most = np.zeros(len(pairs), np.int64)
    least = np.zeros(len(pairs), np.int64)
    for a in range(0, len(pairs), BLOCK_PAIRS):
        first, second = np.array(list(pairs)[a : a + BLOCK_PAIRS], np.int64).T
        found = np.zeros((len(first), STEPS), np.int64)
        # At most STEPS rows for each pair.
        for r in pair_lists(index, vocabulary, model, first, second).toLocalIterator():
            found[r.pair, r.step] = r.n
            most[a + r.pair] = max(most[a + r.pair], r.most)
        # The highest step that k documents reach or pass is a score that an item with this pair gets k times.
        upto = np.cumsum(found[:, ::-1], 1)[:, ::-1] >= k
        step = np.where(upto.any(1), STEPS - 1 - np.argmax(upto[:, ::-1], 1), 0)
        least[a : a + len(first)] = -(-step * _highest(model, first, second) // STEPS)
    single = [np.array([most[pairs[int(a), int(a)]] for a in v], np.int64) for v in terms]
    # A document with one term of the two has that one's impact alone.
    joint = [np.array([max(most[pairs[int(a), int(b)]], x, y) for a, b, x, y in zip(v[:-1], v[1:], s[:-1], s[1:])], np.int64) for v, s in zip(terms, single)]
    lows = [max([0, *(int(least[pairs[int(a), int(b)]]) for a, b in [*zip(v, v), *zip(v[:-1], v[1:])])]) for v in terms]
    return Plan([i for i, _ in block], terms, single, joint, lows)


def bounds(here: np.ndarray, single: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The most that the terms from each place on add, with 0 at the end; terms that are not here add nothing."""
    out = [0, 0]
    for i in range(len(here) - 1, -1, -1):
        own = int(single[i]) if here[i] else 0
        best = own + out[-1]
        if own and i + 1 < len(here) and here[i + 1]:
            best = min(best, int(joint[i]) + out[-2])
        out.append(best)
    return np.array(out[:0:-1], np.int64)


def search_shard(s: Shard, terms: np.ndarray, bound: np.ndarray, least: int, impact: Callable[[int], np.ndarray], some: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of all documents of a shard that score `least` or more, and perhaps others' none:
    terms are added up in full while their bound reaches the threshold, later ones looked up."""
    score = np.zeros(len(s.words), np.int64)
    full = max(1, int(np.searchsorted(-bound[:-1], -least, side="right")))
    for v in terms[:full]:
        score[s.docs[s.at[v] : s.end[v]]] += impact(v)
    docs = np.flatnonzero(score)
    for i in range(full, len(terms)):
        docs = docs[score[docs] + bound[i] >= least]
        if not len(docs):
            break
        v = terms[i]
        own = s.docs[s.at[v] : s.end[v]]
        if len(own):
            p = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            hit = own[p] == docs
            score[docs[hit]] += some(v, p[hit])
    docs = docs[score[docs] >= max(1, least)]
    return docs, score[docs]


class Best:
    """The k best documents of an item so far, by score, then id (null last)."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.null, null])
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def search_block(index: DataFrame, vocabulary, model: Model, plan, k: int) -> DataFrame:
    """(item, doc_id, score): what each task's shards have for each item of a block, k rows at most."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        best = [Best(k, x) for x in p.least]
        for s in Shard.rows(batches, vocabulary.value):
            lengths = model.lengths(s.words)
            ids = s.doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
            null = s.doc_ids.is_null().to_numpy(zero_copy_only=False)
            known: dict[int, np.ndarray] = {}

            def impact(v: int) -> np.ndarray:
                if v not in known:
                    a, b = s.at[v], s.end[v]  # noqa: B023
                    known[v] = model.impacts(v, s.counts[a:b], lengths[s.docs[a:b]])  # noqa: B023
                return known[v]

            def some(v: int, at: np.ndarray) -> np.ndarray:
                if v in known:  # noqa: B023
                    return known[v][at]  # noqa: B023
                at = at + s.at[v]  # noqa: B023
                return model.impacts(v, s.counts[at], lengths[s.docs[at]])  # noqa: B023

            for own, terms, single, joint in zip(best, p.terms, p.single, p.joint):
                bound = bounds(s.end[terms] > s.at[terms], single, joint)
                if bound[0] >= max(1, own.least):
                    docs, scores = search_shard(s, terms, bound, own.least, impact, some)
                    own.add(scores, ids[docs], null[docs])
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.scores) for b in best])
        if len(item):
            whole = [np.concatenate([getattr(b, x) for b in best]) for x in ("ids", "null", "scores")]
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(whole[0], mask=whole[1]), pa.array(whole[2])], names=["item", "doc_id", "score"])

    return index.mapInArrow(scan, "item int, doc_id long, score long")


RANKED = T.StructType([T.StructField(n, t) for n, t in (("item_id", T.LongType()), ("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType()))])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, shard_bytes: int = SHARD_BYTES, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of docs (doc_id, text) for each row of items
    (item_id, text), highest score first, equal scores by ascending doc_id (null last).

    Terms are runs of letters a-z (A-Z lower-cased), digits and non-ASCII characters.  Scores are exact:
    skipping leaves out only documents that can't be among the k.  Repeated documents count and rank as
    rows of their own, repeated items are answered each by itself; items without terms or without a
    document of score above 0 have no rows.  Empty tables give none.  Other columns do no harm.

    Items are searched in blocks of block_terms terms, whose terms and bounds are broadcast; each task keeps k
    rows for each item of the block, and those meet in two steps."""
    spark = docs.sparkSession
    index = stored(build_index(docs, shard_bytes), "index")
    whole = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_words").alias("words")).first()
    out: DataFrame | None = None
    for block in _blocks(stored(item_terms(items), "items"), block_terms) if whole.docs else ():
        with broadcasts(spark) as share:
            vocabulary = share(np.unique(np.concatenate([t for _, t in block])))
            df = document_counts(index, vocabulary, len(vocabulary.value))
            model = Model(whole.docs, whole.words, np.array([weight(whole.docs, int(x)) if x else 0 for x in df], np.int64))
            plan = plan_block(block, index, vocabulary, model, k)
            by_score = [F.desc("score"), F.asc_nulls_last("doc_id")]
            found = search_block(index, vocabulary, model, share(plan), k).withColumn("part", F.spark_partition_id() % 256)
            for keys in (["item", "part"], ["item"]):
                found = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*by_score))).where(F.col("rank") <= k)
            names = spark.createDataFrame(list(enumerate(plan.item_ids)), "item int, item_id long")
            part = stored(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], RANKED)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
docs AS (SELECT doc_id, r, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
postings AS (
  SELECT doc_id, r, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT doc_id, r, n, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), whole),
impacts AS (
  SELECT doc_id, r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_words)))) AS impact
  FROM postings JOIN weights USING (term), whole),
scores AS (SELECT item_id, doc_id, r, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
