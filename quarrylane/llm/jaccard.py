"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles; copies with equal sets are one node.  Tokens
are ordered by an estimate of how many documents hold them (a count sketch of fixed size, over
all documents), rarest first.  If two sets overlap enough, then for any m their prefixes of
length size - needed + m share at least m tokens.  Each document takes the m whose prefix has the
lowest estimated cost (pairs to look at, and candidates to verify); a pair needs the smaller of
its two m.  Candidates are then bounded by counts of hashed tokens and verified on whole sets.

Groups of near copies never expand into all pairs: a first round links each document to the
centre of a few of its tokens, the document made of the commonest tokens, and the full round looks only at pairs of nodes that
are not yet connected.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, broadcasts, build_bloom, mixed, shingle_hashes, slices, stored, table, tokens

SKETCH_BITS = 20
BLOOM_BITS = 26
MOST_MATCHES = 4
STAR_TOKENS = 3
#: A token in more than 1 / HOT_SHARE of all rows of prefixes (so at most HOT_SHARE are), and in LEAST_HOT or more, is hot
#: and its nodes meet in SALTS parts.
HOT_SHARE, LEAST_HOT, SALTS = 1000, 500, 32


def _sets(part: pa.RecordBatch, column: int, size: int) -> Iterator[np.ndarray]:
    t = tokens(part.column(column))
    for a, b in zip(t.bounds[:-1], t.bounds[1:]):
        s = np.sort(shingle_hashes(t.hashes[a:b], size))
        yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _bucket(s: np.ndarray) -> np.ndarray:
    return (mixed(s) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def set_digests(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, tie, n, digest) per row, and among them rows with a null digest that hold a task's
    counts of token buckets: (part number, null, null, null, counts)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "tie", "n", "digest", "counts"]
        for batch in batches:
            for part in slices(batch, 1):
                n, digests = [], []
                for s in _sets(part, 1, size):
                    n.append(len(s))
                    digests.append(_digest(s) if len(s) else b"")
                    if len(s):
                        np.add.at(counts, _bucket(s), 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(len(n), pa.binary())], names)
        if counts.any():
            cut = counts.reshape(64, -1)
            full = np.flatnonzero(cut.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.nulls(len(full), pa.int64()), pa.nulls(len(full), pa.int64()), pa.nulls(len(full), pa.binary()), pa.array([zlib.compress(cut[i].tobytes(), 1) for i in full], pa.binary())], names)

    return docs.mapInArrow(scan, "doc_id long, tie long, n long, digest binary, counts binary")


def read_sketch(parts: DataFrame) -> np.ndarray:
    """Adds the tasks' counts part by part on executors; 2**SKETCH_BITS numbers reach the driver."""
    width = (1 << SKETCH_BITS) // 64

    def add(key, t):
        total = np.zeros(width, np.int64)
        for x in t.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    got = parts.groupBy("part").applyInArrow(add, "part long, counts binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in got:
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(bytes(r.counts), np.int64)
    return out


def prefix_plan(freq: np.ndarray, n: int, needed: int, n_docs: int) -> int:
    """The number m of matches to ask for: the cheapest prefix by estimated cost.

    freq: estimated documents per token of the set, ascending.  The cost of a prefix is its posting
    rows plus, for each document expected to share m of its tokens (Poisson), a look at a set."""
    rows = np.cumsum(np.maximum(0, freq - 1))  # the document itself is one of them
    best, cheapest = 1, np.inf
    for m in range(1, min(MOST_MATCHES, needed) + 1):
        length = n - needed + m
        rate = rows[length - 1] / max(1, n_docs)
        below, term = 0.0, np.exp(-rate)
        for i in range(m):
            below += term
            term *= rate / (i + 1)
        cost = rows[length - 1] + max(0.0, 1 - below) * n_docs * (8 + n / 16)
        if cost < 0.8 * cheapest:
            best, cheapest = m, cost
    return best


def _needed(n: np.ndarray | int, num: int, den: int):
    """Smallest overlap of a set of n with any set of Jaccard num/den or more: ceil(n * num / den)."""
    return -(-n * num // den)


def prefixes(docs: DataFrame, size: int, num: int, den: int, sketch, n_docs: int) -> DataFrame:
    """Per distinct set: node (a number for it), n, matches, its prefix tokens in order, the tokens of its first round, its
    token counts in bins and how common its tokens are.  A task leaves out sets that it has already given (as many as it keeps
    in mind); the others go by dropDuplicates."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq_of, seen = sketch.value, set()
        for batch in batches:
            for part in slices(batch, 1):
                rows: list[list] = [[] for _ in range(7)]
                for s in _sets(part, 1, size):
                    if not len(s) or (d := _digest(s)) in seen:
                        continue
                    if len(seen) < 200_000:
                        seen.add(d)
                    n, f, spread = len(s), freq_of[_bucket(s)], mixed(s)
                    order = np.lexsort((spread, f))
                    need = int(_needed(n, num, den))
                    m = prefix_plan(f[order], n, need, n_docs)
                    few = s[np.argpartition(spread, min(STAR_TOKENS, n) - 1)[:STAR_TOKENS]]
                    bins = np.bincount((s % np.uint64(_bins(n))).astype(np.int64), minlength=_bins(n)).astype("<u4").tobytes()
                    for c, v in zip(rows, (d, n, m, s[order[: n - need + m]].view(np.int64), few.view(np.int64), bins, float(np.log1p(f).mean()))):
                        c.append(v)
                types = [pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], ["digest", "n", "matches", "prefix", "few", "bins", "common"])

    sets = docs.mapInArrow(scan, "digest binary, n int, matches int, prefix array<long>, few array<long>, bins binary, common double").dropDuplicates(["digest"])
    return stored(sets.withColumn("node", F.monotonically_increasing_id()), "prefixes")


def _bins(n: int) -> int:
    """Bins for the counts of a set: about one for 8 tokens, a power of two from 16 to 2048."""
    return 1 << min(11, max(4, (n // 8).bit_length()))


def _overlap_bound(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(b, "<u4").astype(np.int64)
    if len(x) < len(y):
        x, y = y, x
    return int(np.minimum(x.reshape(-1, len(y)).sum(0), y).sum())


def _within_bound(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Drops pairs (a, b) of nodes whose bin counts rule out the needed overlap."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            na, nb, x, y = (c.to_pylist() for c in t.columns[2:])
            ok = [den * o >= num * (p + q - o) for p, q, o in zip(na, nb, map(_overlap_bound, x, y))]
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bins").alias("xa"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bins").alias("xb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(keep, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, num: int, den: int, share) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have Jaccard num/den or more.

    Sets are made again from the texts; only those that a filter of all digests in pairs lets
    through are sent (a Bloom filter of fixed size; what it lets through in excess the join drops)."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    named = stored(ends.join(sets.select("node", "digest"), "node"), "ends")
    ends = named.select(F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long").alias("key"))
    wanted = share(build_bloom(ends, "key", BLOOM_BITS, 4))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, seen = wanted.value, set()
        for batch in batches:
            for part in slices(batch, 1):
                sets = [s for s in _sets(part, 1, size) if len(s)]
                digests = [_digest(s) for s in sets]
                ok = bloom.has(np.array([int.from_bytes(d[:8], "big") for d in digests], np.uint64))
                out = []
                for d, s, k in zip(digests, sets, ok):
                    if k and d not in seen:
                        if len(seen) < 200_000:
                            seen.add(d)
                        out.append((d, s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["digest", "tokens"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sets = docs.mapInArrow(scan, "digest binary, tokens binary").dropDuplicates(["digest"]).join(named, "digest")
    one, two = sets.select(F.col("node").alias("a"), F.col("tokens").alias("xa")), sets.select(F.col("node").alias("b"), F.col("tokens").alias("xb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "xa", "xb").mapInArrow(keep, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that it reaches.

    Alternating large and small stars: in each step every node hands its larger (then its smaller)
    neighbours to the smallest one, until nothing changes.  Each step is written to the shared
    folder; only a count and a checksum come to the driver."""
    edges = stored(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))  # u is a neighbour of v
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select("v", "u", "m")
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).union(small.select("v", F.col("m").alias("u"))).where("u <> v").distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def unconnected_pairs(pre: DataFrame, roots: DataFrame, num: int, den: int, share) -> DataFrame:
    """Pairs (a, b) of nodes with different roots that share enough tokens of their prefixes.

    Tokens that only one node's prefix holds are dropped first (by a Bloom filter of the others).
    Of each token the nodes of its commonest root never meet one another, so a large group costs
    as many rows as it has nodes.  A shared token counts only where it lies within the prefixes
    that the two sizes ask for, which also bounds the overlap by the places of the first one."""
    some = pre.select("node", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("token")
    bloom_b = share(build_bloom(some, "token", BLOOM_BITS, 4))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            size = np.asarray(lists.value_lengths())
            row = np.repeat(np.arange(b.num_rows), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            tok = lists.flatten().to_numpy(zero_copy_only=False)
            ok = bloom_b.value.has(tok.view(np.uint64))
            of = pa.array(row[ok])
            yield pa.RecordBatch.from_arrays([pa.array(tok[ok]), b.column(0).take(of), b.column(1).take(of), b.column(2).take(of), pa.array(place[ok].astype(np.int32))], ["token", "node", "n", "matches", "pos"])

    q = pre.select("node", "n", "matches", "prefix").mapInArrow(scan, "token long, node long, n int, matches int, pos int")
    q = stored(q.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "shared")
    of = q.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(F.count("*").alias("roots"), F.max(F.struct("k", "root")).alias("most"), F.sum("k").alias("held"))
    # The nodes of a hot token meet in SALTS parts; there are HOT_SHARE such tokens at most.
    parts = F.when((F.col("held") * HOT_SHARE > F.lit(q.count())) & (F.col("held") >= LEAST_HOT), SALTS).otherwise(1).alias("parts")
    q = q.join(of.where("roots > 1").select("token", F.col("most.root").alias("major"), parts), "token")
    # A node's first token that some other root has: no pair of it can share an earlier one.
    q = q.withColumn("start", F.min("pos").over(Window.partitionBy("node")))
    r = q.select(*[F.col(c).alias(f"{c}_r") for c in q.columns], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt_r"))
    total = F.col("n") + F.col("n_r")
    alpha = F.floor((total * num + (num + den - 1)) / (num + den)).cast("int")  # the overlap that a link of these sizes needs
    m = F.least("matches", "matches_r")
    within = (F.col("pos") < F.col("n") - alpha + m) & (F.col("pos_r") < F.col("n_r") - alpha + m)
    within &= (F.col("start") <= F.col("n") - alpha) & (F.col("start_r") <= F.col("n_r") - alpha)
    sized = (F.col("n") * den >= F.col("n_r") * num) & (F.col("n_r") * den >= F.col("n") * num)
    once = (F.col("root_r") == F.col("major_r")) | (F.col("node") < F.col("node_r"))
    q = q.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
    rows = q.where("root <> major").join(r, (F.col("token") == F.col("token_r")) & (F.col("salt") == F.col("salt_r")) & (F.col("root") != F.col("root_r")) & once & sized & within)
    rows = rows.groupBy(F.least("node", "node_r").alias("a"), F.greatest("node", "node_r").alias("b")).agg(
        F.count("*").alias("shared"), F.min(m).alias("m"), F.min(alpha).alias("alpha"), F.max(F.least(F.col("n") - F.col("pos"), F.col("n_r") - F.col("pos_r"))).alias("rest")
    )
    return rows.where("shared >= m AND rest >= alpha").select("a", "b")


def jaccard_groups(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, tie, n_shingles, component_id, root) per row of docs (doc_id, text): documents link when the
    Jaccard similarity of their sets of `size`-word shingles is num/den or more, in whole numbers.

    A-Z is lower-cased and words end at ASCII white space; a text with fewer words than `size` is
    one shingle.  component_id is the smallest doc_id that links reach.  Texts without words, null
    or empty, have no shingles, link to nothing and keep their own id.  Rows with equal ids stay
    rows of their own, told apart by tie, a hash of the text; a null id never names a component unless all its ids are null.  Rows with
    equal sets are one node, so copies cost one row each; root numbers the component (null without words).  Other columns are ignored.  Shingles are
    64-bit hashes, sets 128-bit digests.  An empty table gives an empty result."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), F.xxhash64(docs["text"]).alias("tie"))
    first = stored(set_digests(docs, size), "digests")
    rows = first.where("digest IS NOT NULL").drop("counts")
    full = rows.where("n > 0")
    nodes = full.groupBy("digest").agg(F.min("doc_id").alias("least_id"))
    with broadcasts(docs.sparkSession) as share:
        sketch = share(read_sketch(first.where("counts IS NOT NULL").select(F.col("doc_id").alias("part"), "counts")))
        pre = prefixes(docs, size, num, den, sketch, max(1, full.count()))

        # First round: each node with the centre of a few of its tokens, the node whose own tokens are the
        # most common.  In a group of near copies that is the least edited one, to which most link.
        few = pre.select("node", "common", F.explode("few").alias("token"))
        centre = few.groupBy("token").agg(F.max(F.struct("common", "node")).alias("top"), F.count("*").alias("k")).where("k > 1").select("token", F.col("top.node").alias("centre"))
        stars = few.join(centre, "token").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        stars = stored(_within_bound(stars, pre, num, den), "stars")
        links = stored(verified(stars, pre, docs, size, num, den, share), "links")
        roots = stored(components(links), "roots")

        pairs = stored(_within_bound(unconnected_pairs(pre, roots, num, den, share), pre, num, den), "pairs")
        more = stored(verified(pairs, pre, docs, size, num, den, share), "more")
        top = stored(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.select("a", "b"))), "top")
    named = pre.select("digest", "node").join(top, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    ids = nodes.join(named, "digest").groupBy("root").agg(F.min("least_id").alias("component_id"))
    out = rows.join(named.join(ids, "root"), "digest", "left")
    return out.select("doc_id", "tie", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The first columns of jaccard_groups: (doc_id, n_shingles, component_id) per row."""
    return jaccard_groups(docs, size, num, den).select("doc_id", "n_shingles", "component_id")


def one_of_each_group(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs, any columns, without near-duplicates: of each component the document with the smallest
    id stays (null ids last, then by a hash of the text; equal rows leave one).  Documents without
    words all stay.  Names that begin with "__near_" are taken."""
    groups = jaccard_groups(docs, size, num, den).where("n_shingles > 0")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")).alias("k")).select(F.col("k.doc_id").alias("__near_id"), F.col("k.tie").alias("__near_t"))
    keyed = docs.withColumn("__near_tie", F.xxhash64(F.col("text").cast("string")))
    words = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__near_id")) & (F.col("__near_tie") == F.col("__near_t"))
    kept = keyed.where(words).join(first, same, "left_semi").dropDuplicates(["doc_id", "__near_tie"])
    return kept.union(keyed.where(~words)).drop("__near_tie")


#: DuckDB SQL for the rows of jaccard_components; {docs} is a table with doc_id (unique) and text.
JACCARD_SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size} - 1], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE {den} * k >= {num} * (p.n + q.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM {docs} UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM {docs} d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
ORACLE = JACCARD_SQL.format(docs="documents", size=3, num=90, den=100)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 9, 10)
