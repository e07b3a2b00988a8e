"""Toxicity by weak supervision.

Voters look at a text and say toxic, clean or nothing: lists of words and of word beginnings that
mark toxic texts in the labelled training rows (each list holds other terms), a fixed list of
insults, and patterns (commands to be quiet, insults to the reader's face, shouting).  A generative
label model estimates, without looking at the labels, each voter's accuracy and which voters
depend on one another given the hidden label, and a linear classifier is trained on its posterior
labels and then scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_ALNUM, crc_held_out, labelled_sample, labelled_texts, mixed, slices, stored, table, tokens

#: Bound on the labelled rows that the model is fitted on.
MOST_LABELLED = 20_000
STEM = 5
LISTS = 5
#: A term must be absent from clean texts or e**LEAST_ODDS times as likely in toxic ones.
LEAST_ODDS = 4.5
#: ... and stand after so many different words in them.
LEAST_CONTEXTS = 6
#: Common insults in four languages.
INSULTS = (
    "idiot moron stupid loser trash scum pathetic worthless disgusting clown dumb fool jerk imbecile vermin filth "
    "dummkopf trottel depp abschaum widerlich connard abruti ordure idiota estupido basura escoria tonto"
).split()
#: Phrases that silence someone, and ways to say "you are".
COMMANDS = ("shut up", "halt die", "halt dein", "ferme ta", "ta gueule", "callate", "cállate")
ADDRESSES = ("you are", "you re", "du bist", "tu es", "eres un", "eres una")


def _terms(texts: pa.Array):
    """Word and stem hashes, the latter marked apart, with the text of each word."""
    t = tokens(texts, NOT_ALNUM, STEM)
    text = np.repeat(np.arange(len(t.bounds) - 1), np.diff(t.bounds))
    return t, text, t.hashes, t.stems ^ np.uint64(0x5555555555555555)


def toxic_terms(docs: DataFrame) -> np.ndarray:
    """(hash, log odds) of all words and stems that occur mainly in toxic texts of docs (text, label), those
    in the most contexts first.  docs is bounded, so its words are.

    What counts is not texts but different words before a term, by 64 hash bits per term and label:
    the copies of one text, near or exact, repeat its words in the same contexts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                t, text, words, stems = _terms(part.column(0))
                if not len(words):
                    continue
                before = np.zeros(len(words), np.uint64)
                before[1:] = words[:-1]
                before[t.bounds[:-1][np.diff(t.bounds) > 0]] = 0
                bit = np.tile(np.uint64(1) << (mixed(before) & np.uint64(63)), 2)
                toxic = (part.column(1).to_numpy(zero_copy_only=False) == 1)[np.tile(text, 2)]
                term = np.concatenate([words, stems])
                order = np.argsort(term, kind="stable")
                term, bit, toxic = term[order], bit[order], toxic[order]
                at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
                masks = [np.bitwise_or.reduceat(np.where(m, bit, np.uint64(0)), at).view(np.int64) for m in (toxic, ~toxic)]
                for i in range(0, len(at), 100_000):
                    j = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(term[at[j]].view(np.int64)), pa.array(masks[0][j]), pa.array(masks[1][j])], ["term", "toxic", "clean"])

    sizes = docs.groupBy("label").count().collect()
    pos, neg = (max(1, sum(r["count"] for r in sizes if (r["label"] == 1) == x)) for x in (True, False))
    c = docs.mapInArrow(scan, "term long, toxic long, clean long").groupBy("term").agg(F.bit_count(F.bit_or("toxic")).alias("toxic"), F.bit_count(F.bit_or("clean")).alias("clean"))
    odds = F.log((F.col("toxic") + 0.05) / pos) - F.log((F.col("clean") + 0.5) / neg)
    got = c.where(F.col("toxic") >= LEAST_CONTEXTS).withColumn("odds", odds).where((F.col("clean") == 0) | (F.col("odds") > LEAST_ODDS)).orderBy(F.desc("toxic"), F.desc("odds"), "term").collect()
    return np.array([(r.term & (2**64 - 1), r.odds) for r in got], dtype=[("term", np.uint64), ("odds", np.float64)])


def _phrase_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each word with the next (the last with nothing)."""
    after = np.concatenate([words[1:], np.zeros(min(1, len(words)), np.uint64)])
    return mixed(words * np.uint64(0x9FB21C651E98DF25) + after)


class Voters:
    """The voters' counts for texts, the same on the driver and on executors."""

    #: Columns after those of the word lists and the stem lists.
    INSULT, COMMAND, ADDRESS, UPPER, SHARE, ODDS, TOP = range(2 * LISTS, 2 * LISTS + 7)
    COLUMNS = 2 * LISTS + 7

    def __init__(self, terms: np.ndarray):
        rank = np.arange(len(terms))
        order = np.argsort(terms["term"])
        self.terms, self.odds, self.list_of = terms["term"][order], terms["odds"][order], (rank % LISTS)[order]
        self.insults = np.sort(tokens(pa.array(INSULTS)).hashes)
        phrases = [[tokens(pa.array([p]), NOT_ALNUM).hashes for p in group] for group in (COMMANDS, ADDRESSES)]
        self.pairs = [np.array([_phrase_hashes(w)[0] for w in group if len(w) == 2], np.uint64) for group in phrases]
        self.single = np.array([w[0] for w in phrases[0] if len(w) == 1], np.uint64)

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: distinct hits in each list (words, then stems), insults, silencing and "you are"
        phrases, shouting share, share of hits among words, sum and largest of the hits' log odds."""
        t, text, words, stems = _terms(texts)
        n = len(t.bounds) - 1
        out = np.zeros((n, self.COLUMNS))
        every = np.concatenate([words, stems])
        of = np.tile(text, 2)
        kind = np.repeat([0, 1], len(words))
        if len(self.terms):
            at = np.searchsorted(self.terms, every)
            at[at == len(self.terms)] = 0
            hit = self.terms[at] == every
            total = np.bincount(of[hit], minlength=n)
            seen = np.unique(np.stack([of[hit], kind[hit], at[hit]]), axis=1)
            np.add.at(out, (seen[0], seen[1] * LISTS + self.list_of[seen[2]]), 1)
            np.add.at(out[:, self.ODDS], seen[0], self.odds[seen[2]])
            np.maximum.at(out[:, self.TOP], seen[0], self.odds[seen[2]])
            out[:, self.SHARE] = total / np.maximum(1, np.diff(t.bounds))
        out[:, self.INSULT] = np.bincount(text[np.isin(words, self.insults)], minlength=n)
        if len(words):
            pairs = _phrase_hashes(words)
            inside = np.concatenate([text[1:] == text[:-1], [False]])
            for column, known in zip((self.COMMAND, self.ADDRESS), self.pairs):
                out[:, column] = np.bincount(text[np.isin(pairs, known) & inside], minlength=n)
            out[:, self.COMMAND] += np.bincount(text[np.isin(words, self.single)], minlength=n)
        upper = np.concatenate([[0], np.cumsum((t.raw >= 65) & (t.raw <= 90))])
        out[:, self.UPPER] = (upper[t.offsets[1:]] - upper[t.offsets[:-1]]) / np.maximum(1, np.diff(t.offsets))
        return out

    @classmethod
    def votes(cls, f: np.ndarray) -> np.ndarray:
        """1 toxic, -1 clean, 0 nothing, one column per voter."""
        k = 2 * LISTS
        insult = f[:, cls.INSULT] > 0
        yes = [f[:, j] > 0 for j in range(k)]
        yes += [insult, f[:, cls.COMMAND] > 0, insult & (f[:, cls.ADDRESS] > 0), (f[:, cls.UPPER] > 0.3) & (f[:, :k].sum(1) + f[:, cls.INSULT] > 0), f[:, cls.ODDS] > 8]
        no = [f[:, :LISTS].sum(1) == 0, f[:, LISTS:k].sum(1) == 0, ~insult & (f[:, cls.ODDS] < 4)]
        return np.stack([*(y.astype(int) for y in yes), *(-x.astype(int) for x in no)], axis=1)

    @classmethod
    def inputs(cls, f: np.ndarray) -> np.ndarray:
        k = 2 * LISTS
        """Counts and shares for the classifier; no log odds, which come from the labels."""
        x = np.log1p(f[:, : cls.ODDS])
        x[:, cls.UPPER : cls.SHARE + 1] = f[:, cls.UPPER : cls.SHARE + 1]
        return np.hstack([x, np.minimum(1, f[:, : k + 1]), np.log1p(f[:, :k].sum(1, keepdims=True))])


def _dependencies(corr: np.ndarray, least: float) -> np.ndarray:
    """For each voter the voter that it hangs on in the spanning forest of the strongest
    correlations of `least` or more, or -1."""
    k = len(corr)
    parent, done = np.full(k, -1), np.zeros(k, bool)
    best, by = np.full(k, -1.0), np.full(k, -1)
    for _ in range(k):
        j = int(np.argmax(np.where(done, -2.0, best)))
        done[j], parent[j] = True, by[j]
        closer = ~done & (corr[j] >= least) & (corr[j] > best)
        best[closer], by[closer] = corr[j][closer], j
    return parent


def label_model(votes: np.ndarray, rounds: int = 30, least: float = 0.3) -> tuple[np.ndarray, dict]:
    """Posterior of the hidden label for each row of votes (-1, 0, 1), and what was estimated.

    Expectation maximisation of a two-class model in which a voter says -1, 0 or 1 with chances
    that depend on the class and, for voters that still correlate once the class is known, on the
    vote of another one: those correlations make a forest (strongest first), and a voter that only
    repeats another adds nothing to the posterior."""
    n, k = votes.shape
    post = np.where(votes.sum(1) > 0, 0.9, 0.1)
    parent, corr, chance = np.full(k, -1), np.zeros((k, k)), np.empty((2, k, 3))
    said = votes + 1
    for step in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        both = (1 - post, post)
        for c, w in enumerate(both):
            for v in range(3):
                chance[c, :, v] = ((said == v) * w[:, None]).sum(0) + 1.0
            chance[c] /= chance[c].sum(1, keepdims=True)
        if step == 1:  # what the majority of votes leaves correlated is dependence
            mean = chance[:, :, 2] - chance[:, :, 0]
            rest = votes - post[:, None] * mean[1] - (1 - post[:, None]) * mean[0]
            sd = np.maximum(rest.std(0), 1e-6)
            corr = rest.T @ rest / n / np.outer(sd, sd)
            parent = _dependencies(corr - np.eye(k), least)
        score = np.full(n, np.log(prior / (1 - prior)))
        for j in range(k):
            if parent[j] < 0:
                score += np.log(chance[1, j] / chance[0, j])[said[:, j]]
                continue
            cell, logs = said[:, parent[j]] * 3 + said[:, j], []
            for c, w in enumerate(both):
                seen = np.bincount(cell, w, 9).reshape(3, 3)
                logs.append(np.log((seen + 2 * chance[c, j]) / (seen.sum(1, keepdims=True) + 2)).ravel())
            score += (logs[1] - logs[0])[cell]
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return post, {"chance": chance, "correlation": corr, "parent": parent}


def train_linear(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the offset), means and scales of a logistic regression on soft labels."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    keep = np.r_[np.full(len(w) - 1, l2), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(keep), a.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, scale


def toxicity_scores(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """docs (doc_id, text and any other columns) with `score` (replaced if there), from 0 to 1.

    labelled (doc_id, label) is a bounded table of training labels (1 toxic), used to find the
    voters' words; the label model and the classifier see votes only.  Without labelled documents
    only the fixed insults and patterns vote.  Null and empty texts are scored like texts without
    any word that matters.  Every row is scored by itself: null ids, repeats and order don't matter."""
    spark = docs.sparkSession
    docs = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    train = stored(labelled_texts(docs, labelled), "train")
    voters = Voters(toxic_terms(train))
    shared = spark.sparkContext.broadcast(voters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                f = shared.value.features(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(list(f), pa.list_(pa.float64()))], ["f"])

    rows = train.mapInArrow(count, "f array<double>").collect()  # one row per label at most
    f = np.array([r.f for r in rows]).reshape(len(rows), Voters.COLUMNS)
    f = f[np.lexsort(f.T)]  # no result hangs on the order of rows
    if len(f):
        post, _ = label_model(Voters.votes(f))
        model = train_linear(Voters.inputs(f), post)
    else:
        x = Voters.inputs(np.zeros((1, Voters.COLUMNS))).shape[1]
        w = np.zeros(x + 1)
        w[Voters.INSULT], w[-1] = 6.0, -3.0
        model = w, np.zeros(x), np.ones(x)
    model_b = spark.sparkContext.broadcast(model)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields]).add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, mean, scale = model_b.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, at):
                x = (Voters.inputs(shared.value.features(part.column(at))) - mean) / scale
                p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*names, "score"])

    return docs.mapInArrow(score, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = labelled_sample(table(spark, sf_dir, "labels"), "toxic", 5, 0, MOST_LABELLED)
    out = toxicity_scores(docs, known)
    return out.select("doc_id", crc_held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
