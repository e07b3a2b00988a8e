"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of sign flips and a fast Hadamard transform) turns a unit vector;
its hash is the nearest signed axis.  Rows of one dimension and band of length make up an index of
their own.  It has up to `tables` tables; a bucket of a table is a concatenation of as many hashes
(the last over fewer axes) as give buckets of about LEAF rows, so buckets grow in number with the
rows and not in size.  A query looks into the buckets of each table whose axes lie nearest to it
(multiprobe over the concatenation), PROBES * buckets ** PROBE_POWER of them, and its candidates
are ranked by the exact inner product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mixed, stored, table

#: Rows that a bucket holds on average, and buckets probed in a table of b buckets: PROBES * b ** PROBE_POWER.
LEAF, PROBES, PROBE_POWER = 16, 1.2, 0.45
#: Bands of length per doubling.
BANDS = 2
FLUSH = 2_000_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each column (a power of two long), scaled to keep lengths."""
    d, n = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(d // (2 * h), 2, h, n)
        x = np.empty_like(pairs)
        np.add(pairs[:, 0], pairs[:, 1], out=x[:, 0])
        np.subtract(pairs[:, 0], pairs[:, 1], out=x[:, 1])
        h *= 2
    return x.reshape(d, n) / np.sqrt(d)


def _axes(d: int) -> int:
    return 1 << max(1, int(d - 1).bit_length())


def rotated(x: np.ndarray, rotation: int, seed: int) -> np.ndarray:
    """The rows of x after pseudo-rotation number `rotation`."""
    d = _axes(x.shape[1])
    x = np.pad(x, ((0, 0), (0, d - x.shape[1]))).T
    signs = np.random.Generator(np.random.PCG64([seed, rotation])).integers(0, 2, (3, d, 1)) * 2.0 - 1
    for s in signs:
        x = hadamard(np.ascontiguousarray(x * s))
    return x.T


@dataclass(frozen=True)
class Plan:
    """How the rows of one dimension and band are hashed: axes of each concatenated hash, tables,
    probes in each table, and parts that the buckets of a table are dealt to."""

    axes: tuple[int, ...]
    tables: int
    probes: int
    parts: int

    @classmethod
    def of(cls, rows: int, d: int, tables: int, probes: float, group_rows: int) -> Plan:
        axes, left = [], rows / LEAF
        while left > 1:
            axes.append(min(_axes(d), 1 << max(0, int(np.ceil(np.log2(left / 2))))))
            left /= 2 * axes[-1]
        buckets = int(np.prod([2.0 * m for m in axes]))
        return cls(tuple(axes), max(1, min(tables, buckets // 2)), min(buckets, int(np.ceil(probes * buckets**PROBE_POWER))), -(-rows // group_rows))

    def hashes(self, unit: np.ndarray, t: int, seed: int) -> list[np.ndarray]:
        return [rotated(unit, t * 64 + i, seed)[:, :m] for i, m in enumerate(self.axes)]

    def homes(self, unit: np.ndarray, t: int, seed: int) -> np.ndarray:
        """The bucket of each unit vector in table t: its nearest signed axes, as one number."""
        out = np.zeros(len(unit), np.int64)
        for y in self.hashes(unit, t, seed):
            best = np.abs(y).argmax(1)
            out = out * (2 * y.shape[1]) + 2 * best + (y[np.arange(len(y)), best] < 0)
        return out

    def nearest_buckets(self, unit: np.ndarray, t: int, seed: int) -> np.ndarray:
        """For each unit vector the buckets whose axes fall least short of the nearest ones, summed
        over the concatenated hashes; keeping the best after each hash loses none of them."""
        cost, out = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
        for y in self.hashes(unit, t, seed):
            both = np.stack([y, -y], axis=2).reshape(len(y), 2 * y.shape[1])
            short = (both.max(1, keepdims=True) - both) ** 2
            best = _least(short, self.probes)
            cost = (cost[:, :, None] + np.take_along_axis(short, best, 1)[:, None, :]).reshape(len(y), -1)
            out = (out[:, :, None] * both.shape[1] + best[:, None, :]).reshape(len(y), -1)
            keep = _least(cost, self.probes)
            cost, out = np.take_along_axis(cost, keep, 1), np.take_along_axis(out, keep, 1)
        return out

    def part_of(self, bucket: np.ndarray) -> np.ndarray:
        return (mixed(bucket.view(np.uint64)) % np.uint64(self.parts)).astype(np.int32)


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least values of each row, ties by column."""
    return np.argsort(x, axis=1, kind="stable")[:, :k]


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector in a list column."""
    sizes = np.asarray(column.value_lengths())
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes)
    return [(rows := np.flatnonzero(sizes == d), flat[(ends[rows] - d)[:, None] + np.arange(d)]) for d in np.unique(sizes)]


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that squares stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inner product of each row of q with that of x, summed from the first component to the last in
    double precision."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * x[:, k]
    return out


def _first(group: np.ndarray, k: int) -> np.ndarray:
    """True for the first k rows of each run of equal values."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    return np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)])) < k


def candidates(q: np.ndarray, asked: pa.ListArray, x: np.ndarray, bucket: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, row): for each query the k best rows in the buckets that it asks for, ties to
    smaller row numbers.

    A fast product finds those that can be among them; what it leaves is measured exactly."""
    by = np.argsort(bucket, kind="stable")
    known = bucket[by]
    want, lengths = asked.flatten().to_numpy(), np.asarray(asked.value_lengths())
    begin, end = np.searchsorted(known, want), np.searchsorted(known, want, side="right")
    size, cuts = end - begin, np.r_[0, np.cumsum(lengths)]
    longest = np.linalg.norm(x, axis=1).max(initial=0.0)
    of, row = [], []
    for i, v in enumerate(q):
        n = size[cuts[i] : cuts[i + 1]]
        total = int(n.sum())
        if not total:
            continue
        at = np.arange(total) + np.repeat(begin[cuts[i] : cuts[i + 1]] - np.r_[0, np.cumsum(n)[:-1]], n)
        rows = by[at]
        if total > k:
            s = x[rows] @ v
            least = np.partition(s, total - k)[total - k] - 1e-9 * longest * np.linalg.norm(v)
            rows = rows[s >= least]
        of.append(np.full(len(rows), i))
        row.append(rows)
    if not of:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    of, row = np.concatenate(of), np.concatenate(row)
    score = inner_products(q[of], x[row])
    order = np.lexsort((row, -score, of))
    order = order[_first(of[order], k)]
    return of[order], score[order], row[order]


def nearest(vectors: DataFrame, is_query, k: int = 20, tables: int = 16, probes: float = PROBES, group_rows: int = 10_000, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) that meets the
    condition is_query, the k found rows with the largest inner product; ties go to smaller ids.

    Vectors that are null, empty, zero or hold a null, NaN or infinite component take no part, nor
    do rows with a null id; vectors meet only vectors of their own length.  Equal vectors are
    searched once, by the k+1 smallest of their ids, and each query leaves out its own id, so any
    number of equal vectors costs no more than one.  Repeated rows count once; if an id has
    several vectors its best score counts.  Every query is looked up in every band of length of its
    dimension, so long vectors don't hide others; a query that finds fewer than k rows, although
    there are more, meets all of its dimension.  Buckets are dealt to parts of about group_rows
    rows; a part that holds more rows, or is asked by more than group_rows queries, is cut by rows
    and by queries, so no group grows with the table.  Only the counts of rows by dimension and
    band come to the driver.  Other columns are ignored; empty tables give no rows.
    """
    kind = vectors.schema["embedding"].dataType
    kind = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    v = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast(f"array<{kind}>").alias("e"), is_query.alias("q"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where("vec_id IS NOT NULL AND e IS NOT NULL").where(~F.coalesce(bad, F.lit(True))).where(F.exists("e", lambda x: x != 0))
    v = stored(v.withColumn("key", F.xxhash64("e")).withColumn("q", F.coalesce("q", F.lit(False))), "vectors")
    # The smallest ids of each vector, in two steps so that a hot vector is spread first.
    first = Window.partitionBy("key", "e", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    then = Window.partitionBy("key", "e").orderBy("vec_id")
    m = v.select("vec_id", "e", "key").distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    m = m.withColumn("r", F.row_number().over(then)).where(F.col("r") <= k + 1).withColumn("cls", F.min("vec_id").over(Window.partitionBy("key", "e")))
    asks = v.where("q").select("key", "e").distinct().withColumn("asks", F.lit(True))
    most = F.array_max(F.transform("e", lambda x: F.abs(x.cast("double"))))
    size = F.aggregate("e", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most")))
    classes = m.where("r = 1").select("cls", "key", "e").join(asks, ["key", "e"], "left").select("cls", "key", "e", F.coalesce("asks", F.lit(False)).alias("asks"), F.size("e").alias("d"), most.alias("most"))
    classes = stored(classes.withColumn("band", F.floor((F.log2("most") + F.log2(F.sqrt(size))) * BANDS + 0.5).cast("int")).drop("most"), "classes")
    members = stored(m.select("cls", "key", "vec_id", F.size("e").alias("d")), "members")
    # One row for each dimension and band of length; a double's length has some 4,200 bands.
    plans = {(r.d, r.band): Plan.of(r["count"], r.d, tables, probes, group_rows) for r in classes.groupBy("d", "band").count().collect()}

    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            band = b.column(3).to_numpy()
            for rows, x in _matrix(b.column(2)):
                for z in np.unique(band[rows]):
                    own = band[rows] == z
                    plan, unit, of = plans[x.shape[1], int(z)], unit_vectors(x[own]), pa.array(rows[own])
                    bucket = np.stack([plan.homes(unit, t, seed) for t in range(plan.tables)], axis=1)
                    part = plan.part_of(bucket.ravel())
                    ends = pa.array(np.arange(len(of) + 1, dtype=np.int32) * plan.tables)
                    yield pa.RecordBatch.from_arrays([*(b.column(i).take(of) for i in range(4)), pa.ListArray.from_arrays(ends, pa.array(part)), pa.ListArray.from_arrays(ends, pa.array(bucket.ravel()))], ["cls", "key", "e", "band", "parts", "buckets"])

    def ask_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in _matrix(b.column(2)):
                unit = unit_vectors(x)
                for (d, z), plan in plans.items():
                    if d != x.shape[1]:
                        continue
                    for t in range(plan.tables):
                        buckets = plan.nearest_buckets(unit, t, seed)
                        part, of = plan.part_of(buckets.ravel()), np.repeat(np.arange(len(x)), buckets.shape[1])
                        order = np.lexsort((part, of))
                        part, of = part[order], of[order]
                        cut = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, np.int64)
                        lists = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(of)].astype(np.int32)), pa.array(buckets.ravel()[order]))
                        mine, n = pa.array(rows[of[cut]]), len(cut)
                        yield pa.RecordBatch.from_arrays([*(b.column(i).take(mine) for i in range(3)), *(pa.array(np.full(n, c, np.int32)) for c in (d, z, t)), pa.array(part[cut]), lists], ["ask_cls", "ask_key", "ask_e", "d", "band", "t", "part", "buckets"])

    def rank(key, ask, rows):
        asks = [ask.column(c).to_numpy() for c in ("ask_cls", "ask_key")]
        of, score, keys = np.zeros(0, np.int64), np.zeros(0), [np.zeros(0, np.int64)] * 2
        if ask.num_rows and rows.num_rows:
            keys = [rows.column(c).to_numpy() for c in ("cls", "key")]
            order = np.lexsort(keys[::-1])
            x = _matrix(rows.column("e").combine_chunks())[0][1][order]
            q = _matrix(ask.column("ask_e").combine_chunks())[0][1]
            of, score, row = candidates(q, ask.column("buckets").combine_chunks(), x, rows.column("bucket").to_numpy()[order], k + 1)
            keys = [c[order][row] for c in keys]
        cut = pa.array(np.searchsorted(of, np.arange(len(asks[0]) + 1)).astype(np.int32))  # one list for each that asks
        return pa.table([*(pa.array(c) for c in asks), *(pa.ListArray.from_arrays(cut, pa.array(c)) for c in (*keys, score))], ["ask_cls", "ask_key", "cls", "key", "score"])

    def merge(key, t):
        """The best of all lists of some queries."""
        n = np.asarray(t.column("cls").combine_chunks().value_lengths())
        asks = [np.repeat(t.column(c).to_numpy(), n) for c in ("ask_cls", "ask_key")]
        cls, keys, score = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("cls", "key", "score"))
        order = np.lexsort((keys, cls, -score, asks[1], asks[0]))
        cols = [c[order] for c in (*asks, cls, keys, score)]
        same = np.ones(len(order), bool)
        for c in cols[:4]:
            same[1:] &= c[1:] == c[:-1]
        same[:1] = False
        cols = [c[~same] for c in cols]
        _, ask = np.unique(np.stack(cols[:2]), axis=1, return_inverse=True) if len(cols[0]) else (None, cols[0])
        keep = _first(ask.ravel(), k + 1)
        return pa.table([pa.array(c[keep]) for c in cols], ["ask_cls", "ask_key", "cls", "key", "score"])

    near, where = Window.partitionBy("ask_cls", "ask_key"), ["d", "band", "t", "part"]

    def search(asked: DataFrame, index: DataFrame) -> DataFrame:
        """The best k + 1 rows in the buckets that each asks for."""
        # Parts that a hot bucket or hot queries make too large; few, so the joins with them are cheap.
        sizes = index.groupBy(*where).agg(F.ceil(F.count("*") / group_rows).cast("int").alias("n_rows"))
        sizes = sizes.join(asked.groupBy(*where).agg(F.ceil(F.count("*") / group_rows).cast("int").alias("n_asks")), where)
        cuts = stored(sizes.where("n_rows > 2 OR n_asks > 1"), "cuts")
        one = F.lit(1)
        rows = index.join(cuts, where, "left").withColumn("row_cut", F.pmod(F.xxhash64("cls", "key"), F.coalesce("n_rows", one)).cast("int"))
        rows = rows.withColumn("ask_cut", F.explode(F.sequence(F.lit(0), F.coalesce("n_asks", one) - 1))).drop("n_rows", "n_asks")
        asked = asked.join(cuts, where, "left").withColumn("ask_cut", F.pmod(F.xxhash64("ask_cls", "ask_key"), F.coalesce("n_asks", one)).cast("int"))
        asked = asked.withColumn("row_cut", F.explode(F.sequence(F.lit(0), F.coalesce("n_rows", one) - 1))).drop("n_rows", "n_asks")
        by = [*where, "row_cut", "ask_cut"]
        found = asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(rank, "ask_cls long, ask_key long, cls array<long>, key array<long>, score array<double>")
        # Lists of about FLUSH rows meet in a group: as many queries as the plans' parts allow.
        lists = sum(p.tables * min(p.parts, p.probes) for p in plans.values()) * (k + 1)
        groups = n_asks * lists // FLUSH + 1
        found = found.groupBy(F.pmod(F.xxhash64("ask_cls", "ask_key"), F.lit(groups)).alias("group")).applyInArrow(merge, "ask_cls long, ask_key long, cls long, key long, score double")
        found = found.join(members.drop("d"), ["cls", "key"]).withColumn("r", F.row_number().over(near.orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
        return found.select("ask_cls", "ask_key", "vec_id", "score")

    asking = classes.where("asks").select("cls", "key", "e", "d")
    n_asks = asking.count()
    hashed = stored(classes.select("cls", "key", "e", "band").mapInArrow(index_rows, f"cls long, key long, e array<{kind}>, band int, parts array<int>, buckets array<long>"), "hashed")
    index = hashed.select("cls", "key", "e", F.size("e").alias("d"), "band", F.posexplode(F.arrays_zip("parts", "buckets")).alias("t", "h")).select("cls", "key", "e", "d", "band", "t", F.col("h.parts").alias("part"), F.col("h.buckets").alias("bucket"))
    asked = asking.select("cls", "key", "e").mapInArrow(ask_rows, f"ask_cls long, ask_key long, ask_e array<{kind}>, d int, band int, t int, part int, buckets array<long>")
    found = stored(search(stored(asked, "asked"), index), "found")
    # Those that found too few meet all rows, in blocks.
    got = found.groupBy(F.col("ask_cls").alias("cls"), F.col("ask_key").alias("key")).agg(F.count("*").alias("got"))
    room = members.groupBy("d").agg(F.least(F.count("*"), F.lit(k + 1)).alias("room"))
    short = asking.join(room, "d").join(got, ["cls", "key"], "left").where(F.coalesce("got", F.lit(0)) < F.col("room"))
    short = stored(short.select("cls", "key", "e", "d"), "short")
    if not short.isEmpty():
        zero = [F.lit(0).alias("band"), F.lit(0).alias("t")]
        blocks = classes.groupBy("d").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("blocks"))
        asked = short.join(blocks, "d").select(F.col("cls").alias("ask_cls"), F.col("key").alias("ask_key"), F.col("e").alias("ask_e"), "d", *zero, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.array(F.lit(0).cast("long")).alias("buckets"))
        every = classes.join(blocks, "d").select("cls", "key", "e", "d", *zero, F.pmod(F.xxhash64("cls", "key"), F.col("blocks")).cast("int").alias("part"), F.lit(0).cast("long").alias("bucket"))
        done = short.select(F.col("cls").alias("ask_cls"), F.col("key").alias("ask_key"))
        found = found.join(done, ["ask_cls", "ask_key"], "left_anti").unionByName(search(asked, every))
    queries = v.where("q").select(F.col("vec_id").alias("query_id"), F.col("key").alias("ask_key"), "e").distinct()
    ids = asking.select(F.col("cls").alias("ask_cls"), F.col("key").alias("ask_key"), "e")
    out = queries.join(ids, ["ask_key", "e"]).drop("e").join(found, ["ask_key", "ask_cls"]).where("query_id <> vec_id")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank_of = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.select("query_id", rank_of.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
