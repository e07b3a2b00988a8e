"""Benchmark decontamination by greedy string tiling.

Documents and test items that share a seed (a run of SEED words) meet in a join; documents that
share too few seeds to reach the threshold are dropped.  For the others the longest common runs
are found with running Karp-Rabin hashes and marked as tiles, longest first and without overlap,
so a passage whose parts were put in another order is covered as well.  An item is in a document
when tiles cover the threshold share of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _power_tables, broadcasts, build_bloom, mixed, shingle_hashes, slices, stored, table, tokens

SEED = 5
#: A seed in more than 1 / HOT_SHARE of all hits is hot (so at most HOT_SHARE are) and joined in SALTS parts.
HOT_SHARE, SALTS = 1000, 64
COVERAGE = 0.6
BLOOM_BITS = 24


def _windows(sums: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `size` words, from the running sums of a sequence."""
    n = len(sums) - 1
    _, down = _power_tables(n + 1)
    return mixed((sums[size:] - sums[:-size]) * down[: n - size + 1])


def _sums(words: np.ndarray) -> np.ndarray:
    up, _ = _power_tables(len(words) + 1)
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=out[1:])
    return out


def greedy_tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, words) of two sequences of word hashes: the longest
    common run of unmarked words, marked again and again until none of `least` words is left; ties
    go to the earlier place in the item, then in the document.

    The length of the longest run is found by halving: where a run is common, so are its parts."""
    doc_free, item_free = np.ones(len(doc), bool), np.ones(len(item), bool)
    doc_sums, item_sums = _sums(doc), _sums(item)
    tiles: list[tuple[int, int, int]] = []

    def windows(sums: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        marked = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(marked[size:] == marked[:-size])
        return at, _windows(sums, size)[at]

    def common(size: int) -> bool:
        return bool(np.isin(windows(item_sums, item_free, size)[1], windows(doc_sums, doc_free, size)[1]).any())

    most = min(len(doc), len(item))
    while most >= least and common(least):
        size = least
        while size < most:
            half = (size + most + 1) // 2
            size, most = (half, most) if common(half) else (size, half - 1)
        doc_at, doc_hash = windows(doc_sums, doc_free, size)
        order = np.argsort(doc_hash, kind="stable")
        doc_at, doc_hash = doc_at[order], doc_hash[order]
        for q, h in zip(*windows(item_sums, item_free, size)):
            if item_free[q : q + size].all():
                for p in doc_at[np.searchsorted(doc_hash, h, "left") : np.searchsorted(doc_hash, h, "right")]:
                    if doc_free[p : p + size].all() and (doc[p : p + size] == item[q : q + size]).all():
                        doc_free[p : p + size] = item_free[q : q + size] = False
                        tiles.append((int(p), int(q), size))
                        break
        most = size - 1
    return tiles


def _item_words(items: DataFrame) -> DataFrame:
    """(item_id, words, n): the word hashes of each item that has words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                t = tokens(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.hashes[a:b].tobytes() for a, b in zip(t.bounds[:-1], t.bounds[1:])], pa.binary()), pa.array(np.diff(t.bounds).astype(np.int32))], ["item_id", "words", "n"])

    return items.mapInArrow(scan, "item_id long, words binary, n int").where("n > 0")


def _item_seeds(classes: DataFrame) -> DataFrame:
    """(item, place, seed, n): the seeds of each item; the whole of one with fewer words than a seed."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words in enumerate(batch.column(1)):
                w = np.frombuffer(words.as_buffer(), np.uint64)
                s = shingle_hashes(w, SEED)
                k = len(s)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(k, i))), pa.array(np.arange(k, dtype=np.int32)), pa.array(s.view(np.int64)), pa.array(np.full(k, len(w), np.int32))], ["item", "place", "seed", "n"])

    return classes.select("item", "words").mapInArrow(scan, "item string, place int, seed long, n int")


def _asked_seeds(seeds: DataFrame, held: DataFrame, coverage: float) -> tuple[DataFrame, DataFrame]:
    """(seed, salt, item, place, least) that documents must meet, and (seed, hot) of the hot seeds, of which
    there are HOT_SHARE at most.

    Tiles of at least SEED words that cover c words hold m = c / SEED seeds or more.  Of an item's seeds
    that are hot among the documents, the commonest are left out, up to m / 2 of them: a document must
    then share `least`, m less those, of the others, so a phrase that everyone has makes no pairs by
    itself.  Hot seeds that stay are met in SALTS parts."""
    n = held.groupBy("seed").agg(F.count("*").alias("docs"))
    total = held.count()
    hot = stored(n.where(F.col("docs") * HOT_SHARE > total).select("seed", "docs", F.lit(True).alias("hot")), "hot")
    s = seeds.join(F.broadcast(hot), "seed", "left")
    m = F.greatest(F.lit(1), F.ceil(F.col("n") * coverage / SEED - 1e-9))
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc_nulls_last("docs"), "place"))
    s = s.withColumn("out", F.coalesce(F.col("hot") & (nth <= F.floor(m / 2)), F.lit(False)))
    s = s.withColumn("least", m - F.count_if("out").over(Window.partitionBy("item"))).where("NOT out")
    salt = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))).alias("salt")
    return s.select("seed", "item", "place", "least", salt), hot.select("seed", "hot")


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, tie, item_id, coverage, n_tiles, tiles) for each document and item of which tiles
    cover the share `coverage` of the words or more; tiles are (doc_word, item_word, words).

    docs has doc_id and text, items item_id and text.  Words are those of the lower-cased text.
    Items with fewer than SEED words are found where all their words stand together; null and empty
    texts and items without an id match nothing.  Rows with equal ids are told apart by tie, a
    64-bit hash of the text; rows equal in both are reported once.  Items with the same words are
    looked up once, repeated items with equal ids and texts count once.  The items' seeds are
    broadcast only as a Bloom filter of fixed size; all matching is by joins."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    items = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text")).where("item_id IS NOT NULL")
    named = stored(_item_words(items).withColumn("item", F.sha2("words", 256)).dropDuplicates(["item_id", "item"]), "items")
    classes = named.select("item", "words", "n").dropDuplicates(["item"])
    seeds = stored(_item_seeds(classes), "seeds")
    sizes = [SEED, *sorted(r.n for r in classes.where(F.col("n") < SEED).select("n").distinct().collect())]  # at most SEED numbers
    key = F.xxhash64("doc_id", "tie")
    with broadcasts(docs.sparkSession) as share:
        known = share(build_bloom(seeds.select("seed").distinct(), "seed", BLOOM_BITS, 4))

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 2):
                    t = tokens(part.column(2))
                    for size in sizes:
                        if len(t.hashes) < size:
                            continue
                        s = shingle_hashes(t.hashes, size)
                        of = np.searchsorted(t.bounds, np.arange(len(s)), side="right") - 1
                        at = np.flatnonzero(np.arange(len(s)) + size <= t.bounds[of + 1])
                        at = at[known.value.has(s[at])]
                        _, one = np.unique(np.stack([of[at].astype(np.uint64), s[at]]), axis=1, return_index=True) if len(at) else (None, np.zeros(0, int))
                        at = at[one]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of[at])), part.column(1).take(pa.array(of[at])), pa.array(s[at].view(np.int64))], ["doc_id", "tie", "seed"])

        held = stored(docs.select("doc_id", "tie", "text").mapInArrow(hits, "doc_id long, tie long, seed long"), "hits")
        asked, salts = _asked_seeds(seeds, held, coverage)
        held = held.join(F.broadcast(salts), "seed", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "tie"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
        found = held.join(asked, ["seed", "salt"]).groupBy("doc_id", "tie", "item", "least").agg(F.countDistinct("place").alias("k"))
        pairs = stored(found.where("k >= least").select("doc_id", "tie", "item"), "pairs")
        wanted = share(build_bloom(pairs.select(key.alias("key")).distinct(), "key", BLOOM_BITS, 4))

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 2):
                    ok = wanted.value.has(part.column(3).to_numpy(zero_copy_only=False).view(np.uint64))
                    part = part.filter(pa.array(ok))
                    t = tokens(part.column(2))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([t.hashes[a:b].tobytes() for a, b in zip(t.bounds[:-1], t.bounds[1:])], pa.binary())], ["doc_id", "tie", "doc_words"])

        def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                covered, tiles = [], []
                for d, i in zip(batch.column(3), batch.column(4)):
                    item = np.frombuffer(i.as_buffer(), np.uint64)
                    got = greedy_tiles(np.frombuffer(d.as_buffer(), np.uint64), item, min(SEED, len(item)))
                    covered.append(sum(x[2] for x in got) / len(item))
                    tiles.append([dict(zip(("doc_word", "item_word", "words"), x)) for x in sorted(got)])
                kind = pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(covered, pa.float64()), pa.array([len(x) for x in tiles], pa.int32()), pa.array(tiles, kind)], ["doc_id", "tie", "item", "coverage", "n_tiles", "tiles"])

        texts = docs.select("doc_id", "tie", "text", key.alias("key")).mapInArrow(words, "doc_id long, tie long, doc_words binary").dropDuplicates(["doc_id", "tie"]).withColumnsRenamed({"doc_id": "_id", "tie": "_tie"})
        both = pairs.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))).join(classes.select("item", "words"), "item")
        out = both.select("doc_id", "tie", "item", "doc_words", "words").mapInArrow(tile, "doc_id long, tie long, item string, coverage double, n_tiles int, tiles array<struct<doc_word:int,item_word:int,words:int>>")
        out = stored(out.where(F.col("coverage") >= coverage), "contaminated")
    return out.join(named.select("item", "item_id"), "item").select("doc_id", "tie", "item_id", "coverage", "n_tiles", "tiles")


def decontaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs, any columns (names that begin with "__leak_" are taken), without the documents that hold
    a test item.  Null and empty texts hold none; each of several rows with one id is judged by its
    own text, so repeated rows stay or go together, and a null id is an id like others."""
    bad = contaminated(docs, items, coverage).select(F.col("doc_id").alias("__leak_id"), F.col("tie").alias("__leak_t")).distinct()
    keyed = docs.withColumn("__leak_tie", F.xxhash64(F.col("text").cast("string")))
    return keyed.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__leak_id")) & (F.col("__leak_tie") == F.col("__leak_t")), "left_anti").drop("__leak_tie")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item that it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tie")
