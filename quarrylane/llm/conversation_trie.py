"""Prefix trie of conversations that share their beginnings, from composable fingerprints.

The fingerprint of a sequence of turns s_0 .. s_n is the sum of s_i * B**i modulo a prime, in two
lanes.  With its length it is an element of a monoid: that of a sequence put together follows from
those of its parts, fp(xy) = fp(x) + B**len(x) * fp(y).  So the prefixes of rebuilt conversations
(the head of another one, then their own rest) are worked out from the prefixes of the original
ones; their texts are never built.  Each prefix refers to its last turn where it is stored.

Equal fingerprints are checked: turns with equal numbers must have equal roles and texts, and the
prefixes of a group must have the same last turn and the same prefix before it, which with the
same of the group before makes them equal as sequences.  Should a check fail, all is done again
with other numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcasts, stored, table

PRIME = (1 << 61) - 1
#: Conversations come in blocks of SHARE numbers, whose first one lends its head of up to HEADS - 1 turns.
SHARE, HEADS = 100, 6
#: Longest stretch of a conversation, in turns, that is joined in one piece.
STRETCH = 1 << 16
#: Ids of one piece of a list of members lie within 2**PIECE_BITS.
PIECE_BITS = 12
#: A node with more than 1 / HOT_SHARE of all children is hot (so at most HOT_SHARE are).
HOT_SHARE = 1000
LANES = ("1", "2")


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, for numbers below it."""
    a, b = np.asarray(a, np.uint64), np.asarray(b, np.uint64)
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    mid = ah * bl + al * bh
    out = folded(al * bl) + (ah * bh << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << half)
    return folded(out)


def folded(x: np.ndarray) -> np.ndarray:
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(61))
    return np.where(x >= p, x - p, x)


def running_products(symbols: np.ndarray, first: np.ndarray, place: np.ndarray, base: int, carry: int) -> np.ndarray:
    """Fingerprints of all prefixes of some sequences that stand one after another: row i belongs to the one
    that begins at row first[i] and is its place[i]-th turn.  The first sequence may go on from `carry`."""
    here = np.arange(len(symbols)) - first
    powers = np.ones(1, np.uint64)
    while len(powers) <= here.max():
        powers = np.concatenate([powers, times(powers, np.uint64(pow(base, len(powers), PRIME)))])
    shift = np.where(first == 0, np.uint64(pow(base, int(place[0]), PRIME)), np.uint64(1))
    term = times(times(symbols, powers[here]), shift)
    low, high = np.cumsum(term & np.uint64(0xFFFFFFFF)), np.cumsum(term >> np.uint64(32))
    before = np.maximum(first - 1, 0)
    low, high = (np.where(first > 0, x - x[before], x) for x in (low, high))
    out = folded(folded(low) + times(folded(high), np.uint64(1 << 32)))
    return folded(out + np.where(first == 0, np.uint64(carry), np.uint64(0)))


def _bases(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{lane}".encode()).digest()[:8], "big") % (PRIME - 2) + 2 for lane in LANES]


def _turns(conversations: DataFrame, seed: int) -> DataFrame:
    """Turns with two numbers below the prime that stand for role and text."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    symbol = lambda lane: F.xxhash64(F.lit(f"{seed}:{lane}"), role, text).bitwiseAND(F.lit(PRIME >> 1)).alias(f"s{lane}")
    return conversations.select(conversations["conv_id"].cast("long").alias("c"), conversations["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text"), *[symbol(x) for x in LANES]).where("c IS NOT NULL")


NUMBERED = "c long, part int, at long, size long, upto long, s1 long, s2 long, v1 long, v2 long, q1 long, q2 long"


def numbered_turns(turns: DataFrame, bases: list[int]) -> DataFrame:
    """Turns with their place `at` in the conversation, code points `size` and `upto` here, and fingerprints
    with (v) and without them (q).

    A range shuffle puts turns in order, so a conversation of any length is spread over tasks; what
    stands before a task's part of a conversation is added from totals, of which there are at most two
    conversations for each task."""
    order = ["c", "turn", "_role", "_text", "s1", "s2"]
    keyed = turns.select("c", "turn", F.substring("role", 1, 32).alias("_role"), F.substring("text", 1, 32).alias("_text"), "s1", "s2", F.length("text").cast("long").alias("size"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done, size, carry = TaskContext.get().partitionId(), None, 0, 0, [0, 0]
        for b in batches:
            if not b.num_rows:
                continue
            c = b.column(0).to_numpy()
            new = np.ones(len(c), bool)
            new[1:] = c[1:] != c[:-1]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            on = c[0] == last
            at = np.arange(len(c)) - first + np.where(first == 0, done if on else 0, 0)
            sizes = b.column(1).to_numpy()
            total = np.cumsum(sizes)
            upto = total - np.where(first > 0, total[np.maximum(first - 1, 0)], -(size if on else 0))
            cols = [pa.array(c), pa.array(np.full(len(c), part, np.int32)), pa.array(at), pa.array(sizes), pa.array(upto)]
            symbols = [b.column(2 + i).to_numpy().astype(np.uint64) for i in range(2)]
            v = [running_products(s, first, at, base, x if on else 0) for s, base, x in zip(symbols, bases, carry)]
            # Without the last turn: what the row before has, or nothing at the start.
            q = [np.where(first == np.arange(len(c)), np.where(first == 0, np.uint64(x if on else 0), np.uint64(0)), np.roll(y, 1)) for y, x in zip(v, carry)]
            last, done, size, carry = c[-1], int(at[-1]) + 1, int(upto[-1]), [int(x[-1]) for x in v]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(x.astype(np.int64)) for x in (*symbols, *v, *q)], names=[x.split()[0] for x in NUMBERED.split(", ")])

    spark = turns.sparkSession
    rows = stored(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("c", "size", "s1", "s2").mapInArrow(number, NUMBERED), "parts")
    last = F.max(F.struct("at", "upto", "v1", "v2")).alias("x")
    parts = rows.groupBy("c", "part").agg(last)
    cut = parts.join(parts.groupBy("c").count().where("count > 1"), "c").select("c", "part", "x.*").orderBy("c", "part").collect()  # at most two conversations for each task
    if not cut:
        return rows
    before: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for r, prev in zip(cut, [None, *cut]):
        n0, size0, *v0 = before[prev.c, prev.part] if prev and prev.c == r.c else (0, 0, 0, 0)
        if prev and prev.c == r.c:
            v0 = [(x + pow(base, n0, PRIME) * y) % PRIME for x, y, base in zip(v0, (prev.v1, prev.v2), bases)]
            n0, size0 = n0 + prev.at + 1, size0 + prev.upto
        before[r.c, r.part] = (n0, size0, *v0)

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {name: b.column(name).to_numpy().copy() for name in b.schema.names}
            for (c, part), (n0, size0, *v0) in known.value.items():
                i = np.flatnonzero((cols["part"] == part) & (cols["c"] == c)) if part in cols["part"][[0, -1]] else ()
                if n0 and len(i):
                    cols["at"][i] += n0
                    cols["upto"][i] += size0
                    for lane, base, x in zip(LANES, bases, v0):
                        for name in ("v", "q"):
                            y = times(cols[name + lane][i], np.uint64(pow(base, n0, PRIME)))
                            cols[name + lane][i] = folded(y + np.uint64(x)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cols[x]) for x in b.schema.names], names=b.schema.names)

    with broadcasts(spark) as share:
        known = share(before)
        return stored(rows.mapInArrow(shift, NUMBERED), "turns")


def _mod(x: Column) -> Column:
    return F.pmod(x, F.lit(PRIME).cast("decimal(20,0)")).cast("long")


def _moved(v: Column, by: Column, base: int, back: int) -> Column:
    """v * base**by modulo the prime, for by from -back to 0."""
    powers = F.array(*[F.lit(pow(base, -i, PRIME)).cast("decimal(19,0)") for i in range(back + 1)])
    return _mod(v.cast("decimal(19,0)") * F.element_at(powers, (1 - by).cast("int")))


def _sum(a: Column, b: Column) -> Column:
    return _mod(a.cast("decimal(20,0)") + b)


def rebuilt_prefixes(rows: DataFrame, bases: list[int], share: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(prefixes, conversations) of the rebuilt conversations: one row per conversation and depth d from 1 on,
    with the fingerprints of d turns (v) and of d - 1 (q), the last turn's number, code points, stored place
    (turn_conv_id, turn_place), and code points before it; one row per conversation with its number of
    turns, code points and last fingerprint."""
    k, c = F.crc32(F.col("c").cast("string")) % heads, F.col("c")
    at_head = lambda x: F.max(F.when(F.col("at") == k - 1, F.col(x)))
    own = rows.groupBy("c").agg(
        (F.max("at") + 1).alias("n"),
        F.max(F.struct("at", "upto", *[f"v{x}" for x in LANES])).alias("end"),
        F.struct(*[F.coalesce(at_head(x), F.lit(0)).alias(x) for x in ("upto", "v1", "v2")]).alias("cut"),
    ).withColumn("h", k)
    turn = F.struct("at", "size", "upto", "s1", "s2", "v1", "v2", "q1", "q2")
    lent = rows.where((c % share == 0) & (F.col("at") < heads - 1)).groupBy(c.alias("b")).agg(F.sort_array(F.collect_list(turn)).alias("head"))  # heads - 1 turns at most
    convs = own.withColumn("b", c - c % share).join(lent, "b", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast(lent.schema["head"].dataType)), 1, F.col("h").cast("int"))).withColumn("hb", F.size("head").cast("long"))
    tip = lambda x: F.when(F.col("hb") > 0, F.try_element_at("head", F.col("hb").cast("int"))[x]).otherwise(F.lit(0))

    def joined(v: Column, lane: str, base: int) -> Column:
        """Fingerprint of the head and the own turns after the cut, up to own fingerprint v."""
        rest = _mod(v.cast("decimal(20,0)") - F.col("cut")[f"v{lane}"])
        return _sum(tip(f"v{lane}"), _moved(rest, F.col("hb") - F.col("h"), base, heads))

    longer = F.col("n") > F.col("h")
    whole = convs.select(
        "c",
        (F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"),
        (tip("upto") + F.when(longer, F.col("end.upto") - F.col("cut.upto")).otherwise(0)).alias("upto"),
        *[F.when(longer, joined(F.col(f"end.v{x}"), x, b)).otherwise(tip(f"v{x}")).alias(f"v{x}") for x, b in zip(LANES, bases)],
    )
    stretch = F.floor(F.col("at") / STRETCH)
    pieces = convs.where(longer).select("c", "h", "hb", "cut", F.struct(*[tip(x).alias(x) for x in ("upto", "v1", "v2")]).alias("tip"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / STRETCH))).alias("stretch"))
    tip2 = lambda x: F.col("tip")[x]

    def moved(v: str, lane: str, base: int) -> Column:
        rest = _mod(F.col(v + lane).cast("decimal(20,0)") - F.col("cut")[f"v{lane}"])
        return _sum(tip2(f"v{lane}"), _moved(rest, F.col("hb") - F.col("h"), base, heads)).alias(v + lane)

    own_part = rows.withColumn("stretch", stretch).join(pieces, ["c", "stretch"]).where("at >= h").select(
        "c", (F.col("hb") + F.col("at") - F.col("h") + 1).alias("d"), "size", "s1", "s2",
        (F.col("tip.upto") + F.col("upto") - F.col("size") - F.col("cut.upto")).alias("before"),
        c.alias("turn_conv_id"), F.col("at").alias("turn_place"),
        *[moved(v, x, b) for x, b in zip(LANES, bases) for v in "vq"],
    )
    t = F.col("t")
    head_part = convs.select("c", "b", F.explode("head").alias("t")).select(
        "c", (t["at"] + 1).alias("d"), t["size"].alias("size"), t["s1"].alias("s1"), t["s2"].alias("s2"),
        (t["upto"] - t["size"]).alias("before"), F.col("b").alias("turn_conv_id"), t["at"].alias("turn_place"),
        *[t[v + x].alias(v + x) for x in LANES for v in "vq"],
    )
    return head_part.unionByName(own_part), whole


KEY = ["v1", "v2", "d"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _with_parents(nodes: DataFrame, total: int) -> DataFrame:
    """Adds the parent's smallest member to nodes of depth 2 or more; children of hot parents stay where they are."""
    parents = nodes.select(F.col("v1").alias("q1"), F.col("v2").alias("q2"), (F.col("d") + 1).alias("d"), F.col("conv_id").alias("parent_conv_id"), "n_children").where("n_children > 0")
    hot = (F.col("n_children") * HOT_SHARE > total)
    key, below = ["q1", "q2", "d"], nodes.where("d > 1")
    hottest = F.broadcast(parents.where(hot).drop("n_children"))
    return below.join(hottest, key).unionByName(below.join(hottest.drop("parent_conv_id"), key, "left_anti").join(parents.where(~hot).drop("n_children"), key))


def member_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids c of each key, ascending.  Ids are put together in pieces of bounded
    size first; the digest of a list is sequential, so one task reads a node's pieces as a stream."""
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids")
    pieces = ends.groupBy(*KEY, F.shiftright("c", PIECE_BITS).alias("piece")).agg(piece)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for b in batches:
            for *k, ids in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if k != key:
                    if sha:
                        out.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=[*KEY, "ends_sha256"])
                out = []
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], names=[*KEY, "ends_sha256"])

    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids").mapInArrow(digest, "v1 long, v2 long, d long, ends_sha256 string")


def _equal(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [F.min(n) == F.max(n) for n in names])


def conversation_trie(conversations: DataFrame, share: int = SHARE, heads: int = HEADS, seeds: int = 8) -> DataFrame:
    """The nodes of the prefix trie of rebuilt conversations, with turn_conv_id and turn_place (from 0), where
    the last turn of each is stored.

    Conversation c is rebuilt from the first h turns of conversation c - c % share and its own turns after
    its first h, h being crc32 of c in decimal modulo `heads`.  Turns go by number (null first), equal ones
    by role, then text (by their first 32 code points and two hashes); repeated rows are turns of
    their own.  Null roles and texts are empty, rows without conv_id take no part, an empty table has no
    node.  Other columns do no harm."""
    for seed in range(seeds):
        bases = _bases(seed)
        turns = _turns(conversations, seed)
        same = turns.groupBy("s1", "s2").agg((_equal("role") & _equal("text")).alias("same"))
        if same.where("NOT same").limit(1).count():
            continue
        prefixes, convs = rebuilt_prefixes(numbered_turns(turns, bases), bases, share, heads)
        prefixes, convs = stored(prefixes, "prefixes"), stored(convs, "conversations")
        first = F.min(F.struct("c", "turn_conv_id", "turn_place"))
        nodes = prefixes.groupBy(*KEY).agg(
            first.alias("own"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.max("before").alias("before"),
            F.max("q1").alias("q1"), F.max("q2").alias("q2"), _equal("q1", "q2", "s1", "s2", "size").alias("same"),
        )
        nodes = stored(nodes.select(*KEY, F.col("own.c").alias("conv_id"), "n_convs", "size", "before", "q1", "q2", "same", "own.turn_conv_id", "own.turn_place"), "nodes")
        if not nodes.where("NOT same").limit(1).count():
            break
    else:
        raise ValueError(f"no seed of {seeds} gives different turns and prefixes different numbers")

    children = nodes.groupBy(F.col("q1").alias("v1"), F.col("q2").alias("v2"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, KEY, "left").fillna(0, ["n_children"]), "parents")
    # The nodes whose smallest member is c are those from some depth on; up to there, a text of c is one more copy.
    own = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.min(F.struct("d", "before")).alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    marks = convs.join(own, "c", "left").select("c", "depth", F.coalesce("own.d", F.col("depth") + 1).alias("own_from"), F.coalesce("own.before", "upto").alias("copied"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    marks = marks.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("depth") / STRETCH))).alias("stretch"))
    per = prefixes.select("c", *KEY, "before", F.floor(F.col("d") / STRETCH).alias("stretch")).join(marks, ["c", "stretch"])
    sums = per.groupBy(*KEY).agg(F.sum(F.when(F.col("d") < F.col("own_from"), F.col("copied") - F.col("before")).otherwise(0)).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    digests = stored(member_digests(convs.select("v1", "v2", F.col("depth").alias("d"), "c")), "digests")

    # What the root needs: one row each.
    whole = nodes.agg(F.count_if(F.col("d") == 1).alias("n_children"), F.count_if(F.col("n_children") == 0).alias("leaves"), F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("size")), F.lit(0)).alias("saved_tokens"), F.count("*").alias("nodes")).first()
    root = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    ended = digests.where("d = 0").select("ends_sha256").agg(F.max("ends_sha256").alias("ends_sha256"))
    none = F.lit(None).cast("long")
    top = root.join(F.broadcast(ended)).select(
        "conv_id", F.lit(0).cast("long").alias("depth"), none.alias("parent_conv_id"), "n_convs", F.lit(whole.n_children).alias("n_children"), F.lit(max(1, whole.leaves)).cast("long").alias("n_leaves"),
        F.lit(whole.saved_tokens).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), none.alias("turn_conv_id"), none.alias("turn_place"),
    )
    first_level = nodes.where("d = 1").join(F.broadcast(root.select(F.col("conv_id").alias("parent_conv_id"))))
    below = first_level.unionByName(_with_parents(nodes, whole.nodes)).join(sums, KEY).join(digests, KEY, "left")
    return top.unionByName(below.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), "turn_conv_id", "turn_place"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)), 4294967295) % 6 AS h
  FROM (SELECT c, count(*) AS n FROM turns GROUP BY c)),
heads AS (SELECT convs.c, convs.h, least(convs.h, coalesce(b.n, 0)) AS hb FROM convs LEFT JOIN convs AS b ON b.c = convs.c - convs.c % 100),
rebuilt AS (
  SELECT heads.c, pos + 1 AS d, role, text FROM heads JOIN turns ON turns.c = heads.c - heads.c % 100 AND pos < hb
  UNION ALL
  SELECT heads.c, hb + pos - h + 1, role, text FROM heads JOIN turns ON turns.c = heads.c AND pos >= h),
paths AS (SELECT c, d, length(text) AS size, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY d) AS path FROM rebuilt),
ends AS (
  SELECT coalesce(path, []) AS path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha
  FROM (SELECT convs.c, max_by(path, d) AS path FROM convs LEFT JOIN paths USING (c) GROUP BY convs.c) GROUP BY 1),
nodes AS (
  SELECT path, min(c) AS conv_id, d AS depth, count(*) AS n_convs, any_value(size) AS size FROM paths GROUP BY path, d
  UNION ALL SELECT [], min(c), 0, count(*), 0 FROM convs HAVING count(*) > 0),
kids AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
up AS (SELECT c, d, path FROM paths UNION ALL SELECT c, 0, [] FROM convs),
below AS (
  SELECT up.path, CAST(count(*) FILTER (known.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens
  FROM known JOIN up ON up.c = known.conv_id AND up.d <= known.depth GROUP BY up.path)
SELECT known.conv_id, known.depth, p.conv_id AS parent_conv_id, known.n_convs, known.n_children, n_leaves, saved_tokens, coalesce(sha, sha256('')) AS ends_sha256,
  CASE WHEN known.depth > hb THEN known.conv_id WHEN known.depth > 0 THEN known.conv_id - known.conv_id % 100 END AS turn_conv_id,
  CASE WHEN known.depth > hb THEN known.depth - hb + h - 1 WHEN known.depth > 0 THEN known.depth - 1 END AS turn_place
FROM known JOIN below USING (path) JOIN heads ON heads.c = known.conv_id LEFT JOIN ends USING (path)
LEFT JOIN nodes AS p ON known.depth > 0 AND p.path = known.path[:known.depth - 1]
"""
