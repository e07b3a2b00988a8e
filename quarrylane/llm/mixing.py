"""Mixing sources to target weights, with DataFrame operations only.

Each source's words are packed, document after document, into blocks of a fixed length.  The mix is
a row of slots, `shard_slots` to an output shard.  Which source a slot takes is drawn without
replacement from all sources' expected slots, by a pseudorandom permutation of the slots' numbers:
every shard's source counts are multinomial given that the totals come out at the targets (plain
multinomial draws would leave a source of 100 blocks 10 % off).  The draw also numbers a source's
slots; number i reads the block at place i mod n of the source's own pseudorandom permutation
number i div n of its n blocks, so each block is read once before any is read twice.  Slots and
packed pieces of documents meet by an equi-join on (source, block).

A permutation maps an index by arithmetic alone (swap-or-not rounds): no order, no window.  Running
sums of words are taken in two levels, within chunks of about CHUNK documents by a hash of the id
and over chunk totals, so a hot source is never ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
SHARD_SLOTS = 1024
CHUNK = 1000
#: Rounds of a permutation; equal cells of the slots' numbers for the join with the sources' ranges.
ROUNDS = 12
CELLS = 4096
_P = 2147483647


def _scramble(x: Column) -> Column:
    """A pseudorandom number below 2**31 - 1 from any non-negative number."""
    p = F.lit(_P).cast("long")
    x = (x % p * F.lit(48271) + ((x - x % p) / p).cast("long") % p + F.lit(1013904223)) % p
    x = (x * (x % F.lit(65537) + F.lit(1)) + F.lit(374761393)) % p
    return (x * F.lit(69621) + F.lit(668265263)) % p


def _scramble_int(x: int) -> int:
    """_scramble of a plain number."""
    x = (x % _P * 48271 + x // _P % _P + 1013904223) % _P
    x = (x * (x % 65537 + 1) + 374761393) % _P
    return (x * 69621 + 668265263) % _P


def constant_keys(n: int, key: int) -> Column:
    """round_keys of plain numbers, worked out once."""
    at = [key * (ROUNDS + 1) + r for r in range(1, ROUNDS + 1)]
    return F.array(*[F.lit((_scramble_int(x) * _P + _scramble_int(x + 500_009)) % n).cast("long") for x in at])


def round_keys(n: Column, key: Column) -> Column:
    """The keys below n of the permutation numbered `key` of 0 .. n - 1."""
    wide = lambda x: _scramble(x) * F.lit(_P).cast("long") + _scramble(x + F.lit(500_009))
    return F.transform(F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long")), lambda r: wide(key * F.lit(ROUNDS + 1) + r) % n)


def permuted(x: Column, n: Column, keys: Column) -> Column:
    """Where the permutation of 0 .. n - 1 takes x.  A round pairs x with key - x (modulo n) and
    swaps the two or not, by a hash of the larger: a bijection for any n."""
    p = F.lit(_P).cast("long")

    def swap(x: Column, key: Column) -> Column:
        other = (key + n - x) % n
        mark = (F.greatest(x, other) % p * F.lit(48271) + key % p) % p
        return F.when((mark * mark + F.lit(1013904223)) % p % F.lit(2) == 1, other).otherwise(x)

    return F.aggregate(keys, x, swap)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source of `sized` (source, size): its order sid, size, documents, weight and target.

    Sources in code-point order, null last, get the weights in turn.  Together the targets are
    all sizes; no target is above `most` times its source's size, the excess goes to the others
    by weight.  This is the level at which min(weight * level, most * size) adds up to the total,
    found by filling sources in the order of most * size / weight.
    One row per source: the windows without a partition see as many rows as there are sources."""
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    per = per.select("*", n.cast("long").alias("sid")).select("*", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, whole = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total, weight_all = F.sum("source_size").over(whole), F.sum("weight").over(whole)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (weight_all - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.select("*", level.alias("level")).withColumn("full", F.col("cap") < F.col("weight") * F.col("level"))
    shared = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(whole)["level"]
    return per.select("source", "sid", "source_size", "n_docs", "weight", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * shared).alias("target"))


def _running(df: DataFrame, by: list[str], chunk: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over earlier rows of the same `by`, ordered by chunk and then `order`."""
    totals = df.groupBy(*by, chunk).agg(F.sum(value).alias("_in_chunk"))
    w = Window.partitionBy(*by).orderBy(F.col(chunk)).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, chunk, F.coalesce(F.sum("_in_chunk").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*by, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.select("*", F.coalesce(F.sum(value).over(inner), F.lit(0)).alias("_within"))
    return df.join(totals, [*by, chunk]).withColumn(name, F.col("_before") + F.col("_within")).drop("_before", "_within")


def mix_plan(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, most: int = MOST, seed: int = 1) -> DataFrame:
    """(shard, slot, sid, epoch, block): which block of which source each slot of the mix holds.
    Counted by (shard, sid) it gives the drawn source counts of every shard."""
    spark = sources.sparkSession
    s = sources.where("source_size > 0").select("sid", F.ceil(F.col("source_size") / block).alias("n_blocks"), "target", "source_size")
    s = s.withColumn("slots", F.least(F.col("n_blocks") * most, F.round(F.col("target") / F.col("source_size") * F.col("n_blocks")).cast("long")))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("hi", F.sum("slots").over(upto)).withColumn("lo", F.col("hi") - F.col("slots")).where("slots > 0")
    epoch_keys = [round_keys(F.col("n_blocks"), F.col("sid") * 16 + F.lit(1 + e + 1000 * seed)) for e in range(most)]
    s = stored(s.select("sid", "n_blocks", "lo", "hi", F.array(*epoch_keys).alias("keys")), "ranges")
    total = s.agg(F.max("hi")).first()[0] or 0
    width = total // CELLS + 1
    ranges = s.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    n = F.lit(total).cast("long")
    draw = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, total // 1_000_000)).withColumnRenamed("id", "slot")
    draw = draw.withColumn("t", permuted(F.col("slot"), n, constant_keys(max(1, total), 1000 * seed))).withColumn("cell", F.floor(F.col("t") / width))
    draw = draw.join(ranges, "cell").where("t >= lo AND t < hi").withColumn("i", F.col("t") - F.col("lo"))
    draw = draw.withColumn("epoch", F.floor(F.col("i") / F.col("n_blocks")).cast("int"))
    block_no = permuted(F.col("i") % F.col("n_blocks"), F.col("n_blocks"), F.element_at("keys", F.col("epoch") + 1))
    return stored(draw.select(F.floor(F.col("slot") / shard_slots).alias("shard"), "slot", "sid", "epoch", block_no.alias("block")), "plan")


def _sized(docs: DataFrame) -> DataFrame:
    """Size and place hash of each document; tie orders rows with equal ids and sizes."""
    text = docs["text"].cast("string")
    sized = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("tie"), text.alias("text"))
    place = _scramble(F.pmod(F.coalesce("doc_id", F.lit(0).cast("long")), F.lit(_P).cast("long")) * F.lit(4099) + F.col("size") % F.lit(4099))
    return sized.withColumn("h", place)


def _placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents that have words, with `at`: how many words of the source lie before them."""
    s = sources.select(F.col("source").alias("_source"), "sid", "source_size", "target", "n_docs")
    d = sized.where("size > 0").join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    d = d.withColumn("chunk", F.floor(F.col("h") * F.ceil(F.col("n_docs") / CHUNK) / F.lit(_P))).drop("n_docs")
    return _running(d, ["sid"], "chunk", [F.col("h"), F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("tie")], "size", "at")


def packed_pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every document's words by the blocks that they fall in: adds block, first (the piece's first
    word in the document, from 0) and n (its words).  Very long documents become many rows."""
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    pieces = pieces.withColumn("first", F.greatest(F.col("block") * block - F.col("at"), F.lit(0).cast("long")))
    return pieces.withColumn("n", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.col("at") - F.col("first"))


def mixed_blocks(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 1) -> DataFrame:
    """The mix itself: (shard, slot, source, epoch, block, doc_ids, words), one row per slot, with the
    words of its block in order and the documents that they come from.  Nulls, ties, repeats and
    empty tables: as for mix_sources, of which this is the same mix."""
    sized = _sized(docs)
    sources = stored(source_targets(sized, weights, most), "sources")
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("first") + 1).cast("int"), F.col("n").cast("int"))
    pieces = packed_pieces(_placed(sized, sources), block).select("sid", "source", "block", "at", "doc_id", words.alias("words"))
    plan = mix_plan(sources, block, shard_slots, most, seed)
    whole = pieces.join(plan, ["sid", "block"]).groupBy("shard", "slot", "source", "epoch", "block").agg(F.sort_array(F.collect_list(F.struct("at", "doc_id", "words"))).alias("p"))
    return whole.select("shard", "slot", "source", "epoch", "block", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.words").alias("words"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 1) -> DataFrame:
    """One row per row of docs (doc_id, text, source): size in words, its source's size and target,
    and how many of its words the mix takes, repeats counted: the words of its packed pieces, once
    for each slot that holds their block.

    A null text has size 0; documents of size 0 take nothing.  Null sources are one source.  Rows
    with equal ids are documents of their own, told apart by size and a hash of the text.  No
    source has slots for more than `most` times its blocks, so no document is taken more than
    `most` times.  An empty table gives an empty result.  Other columns are ignored, so
    clashing names do no harm.  The same rows give the same mix in any partitioning.
    """
    sized = stored(_sized(docs).drop("text"), "sized")
    sources = stored(source_targets(sized, weights, most), "sources")
    placed = stored(_placed(sized, sources).select("doc_id", "sid", "size", "source_size", "target", "at"), "placed")
    plan = mix_plan(sources, block, shard_slots, most, seed)
    pieces = packed_pieces(placed, block).join(plan.select("sid", "block", "slot"), ["sid", "block"], "left")
    taken = F.sum(F.when(F.col("slot").isNotNull(), F.col("n")).otherwise(F.lit(0))).cast("long")
    out = pieces.groupBy("sid", "at", "doc_id", "size", "source_size", "target").agg(taken.alias("taken"))
    s = sources.select(F.col("source").alias("_source"), "source_size", "target")
    none = sized.where("size = 0").join(s, F.col("source").eqNullSafe(F.col("_source"))).withColumn("taken", F.lit(0).cast("long"))
    names = ["doc_id", "size", "source_size", "target", "taken"]
    return out.select(*names).unionByName(none.select(*names))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def _scramble_sql(x: str) -> str:
    a = f"((({x}) % {_P}) * 48271 + ({x}) // {_P} % {_P} + 1013904223) % {_P}"
    b = f"(({a}) * (({a}) % 65537 + 1) + 374761393) % {_P}"
    return f"(({b}) * 69621 + 668265263) % {_P}"


def _keys_sql(n: str, key: str) -> str:
    at = f"(({key}) * {ROUNDS + 1} + r)"
    return f"list_transform(range(1, {ROUNDS + 1}), lambda r: (({_scramble_sql(at)}) * {_P} + {_scramble_sql(at + ' + 500009')}) % ({n}))"


def _permuted_sql(x: str, n: str, keys: str) -> str:
    other = f"((k + ({n}) - x) % ({n}))"
    mark = f"((greatest(x, {other}) % {_P} * 48271 + k % {_P}) % {_P})"
    return f"list_reduce(list_prepend(({x})::BIGINT, {keys}), lambda x, k: CASE WHEN ({mark} * {mark} + 1013904223) % {_P} % 2 = 1 THEN {other} ELSE x END)"


#: DuckDB SQL for mix_sources' rows; {docs} is a table with doc_id, text and source.
MIX_SQL = f"""
WITH sized AS (SELECT *, {_scramble_sql(f"((coalesce(doc_id, 0) % {_P} + {_P}) % {_P}) * 4099 + size % 4099")} AS h
    FROM (SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {{docs}})),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([5, 2, 1][CAST(sid % 3 + 1 AS INT)] AS DOUBLE) AS weight, CAST({MOST} * source_size AS DOUBLE) AS cap FROM per),
levels AS (SELECT *, ((SELECT sum(source_size) FROM per) - coalesce(sum(cap) OVER f, 0)) / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER f, 0)) AS lvl
    FROM weighed WINDOW f AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sources AS (SELECT source, sid, source_size, CASE WHEN cap < weight * lvl THEN cap ELSE weight * (SELECT lvl FROM levels WHERE NOT cap < weight * lvl ORDER BY cap / weight, sid LIMIT 1) END AS target FROM levels),
e AS (SELECT sid, target / source_size * ceil(source_size / {BLOCK}.0) AS expected, ceil(source_size / {BLOCK}.0)::BIGINT AS n_blocks FROM sources WHERE source_size > 0),
r AS (SELECT sid, n_blocks, least(n_blocks * {MOST}, CAST(round(expected) AS BIGINT)) AS slots FROM e),
ranges AS (SELECT sid, n_blocks, hi - slots AS lo, hi FROM (SELECT *, CAST(sum(slots) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM r) WHERE slots > 0),
total AS (SELECT n, {_keys_sql("n", "1000")} AS keys FROM (SELECT CAST(max(hi) AS BIGINT) AS n FROM ranges) WHERE n > 0),
draw AS (SELECT {_permuted_sql("slot", "n", "keys")} AS t FROM (SELECT n, keys, unnest(range(n)) AS slot FROM total)),
epochs AS (SELECT sid, n_blocks, lo, hi, epoch, {_keys_sql("n_blocks", "sid * 16 + 1001 + epoch")} AS keys FROM (SELECT *, unnest(range({MOST})) AS epoch FROM ranges)),
plan AS (SELECT sid, {_permuted_sql("(t - lo) % n_blocks", "n_blocks", "keys")} AS block FROM draw JOIN epochs ON t >= lo AND t < hi AND (t - lo) // n_blocks = epoch),
times AS (SELECT sid, block, count(*) AS times FROM plan GROUP BY ALL),
d AS (SELECT s.*, o.sid, o.source_size, o.target, row_number() OVER () AS row_no, coalesce(sum(size) OVER (PARTITION BY o.sid ORDER BY h, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS word_at
    FROM sized s JOIN sources o ON s.source IS NOT DISTINCT FROM o.source),
parts AS (SELECT row_no, sid, word_at, size, unnest(range(word_at // {BLOCK}, (word_at + size - 1) // {BLOCK} + 1)) AS block FROM d WHERE size > 0),
taken AS (SELECT row_no, sum((least(word_at + size, (p.block + 1) * {BLOCK}) - greatest(word_at, p.block * {BLOCK})) * times)::BIGINT AS taken FROM parts p JOIN times t ON p.sid = t.sid AND p.block = t.block GROUP BY row_no)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM d LEFT JOIN taken t ON d.row_no = t.row_no
"""
ORACLE = MIX_SQL.replace("{docs}", "documents")
