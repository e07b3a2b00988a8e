"""Substring dedup by hashing lines and the sentences in them.

A unit is a run of words up to one that ends in '.', '!' or '?', or to the end of its line; a
sentence of LONG words or more also ends a unit after each word whose hash is divisible by CUT,
so that a passage set into other text shares most of its units wherever it begins.  A unit is
normalised to its lower-cased words and hashed; over all documents the earliest occurrence of
each digest, by doc_id and place, is kept.  Other occurrences go where they are whole lines of
min_line_words words or more, and inside lines where consecutive ones make up at least min_words
words (a short sentence that recurs by chance stays, a repeated passage goes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _power_tables, broadcasts, build_bloom, mixed, slices, stored, table, tokens

MIN_WORDS = 25
#: Repeated whole lines and paragraphs go from so many words on.
MIN_LINE_WORDS = 13
LONG, CUT = 16, 8
#: A digest with more than 1 / HOT_SHARE of all repeated units is hot (so at most HOT_SHARE are) and joined in SALTS parts.
HOT_SHARE, SALTS = 1000, 64
BLOOM_BITS = 26


def units(t) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, digest, text) of all units of some tokenised texts, in order."""
    n = len(t.hashes)
    if not n:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    last = t.raw[t.ends - 1]
    stop = (last == 0x2E) | (last == 0x21) | (last == 0x3F)
    lines = np.concatenate([[0], np.cumsum(t.raw == 0x0A)])
    stop[:-1] |= lines[t.starts[1:]] > lines[t.ends[:-1]]
    stop[t.bounds[1:][t.bounds[1:] > t.bounds[:-1]] - 1] = True
    words = np.diff(np.flatnonzero(np.concatenate([[True], stop])))
    stop |= (np.repeat(words, words) >= LONG) & (t.hashes % np.uint64(CUT) == 0)
    end = np.flatnonzero(stop) + 1
    begin = np.concatenate([[0], end[:-1]])
    # Word hashes weighed by their place in the unit, added up: the order of words counts.
    place = np.arange(n) - np.repeat(begin, end - begin)
    up, _ = _power_tables(int(place.max()) + 1)
    digest = mixed(np.add.reduceat(t.hashes * up[place], begin) + (end - begin).astype(np.uint64))
    return begin, end, digest, np.searchsorted(t.bounds, begin, side="right") - 1


def _unit_rows(docs: DataFrame, only=None) -> DataFrame:
    """One row per unit of docs; of those alone that a broadcast filter of digests lets through."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                t = tokens(part.column(2))
                begin, end, digest, text = units(t)
                place = np.arange(len(begin)) - np.searchsorted(begin, t.bounds[:-1])[text]
                at = np.arange(len(begin)) if only is None else np.flatnonzero(only.value.has(digest))
                for i in range(0, len(at), 50_000):
                    j = at[i : i + 50_000]
                    of = pa.array(text[j])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(of), part.column(1).take(of), pa.array(place[j].astype(np.int32)), pa.array(digest[j].view(np.int64)), pa.array((end - begin)[j].astype(np.int32))],
                        ["doc_id", "tie", "unit", "digest", "words"],
                    )

    return docs.mapInArrow(scan, "doc_id long, tie long, unit int, digest long, words int")


def repeated_units(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, units): for docs (doc_id, tie, text) the array of (unit, words, kept_doc_id) of
    all units of which an earlier one exists; tie tells rows with equal ids and other texts apart.

    Only units that a Bloom filter of all repeated digests lets through meet the kept ones; hot
    digests meet them in SALTS parts."""
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", "unit")
    kept = _unit_rows(docs).groupBy("digest").agg(F.min(rank).alias("kept"), F.max(rank).alias("last"), F.count("*").alias("n")).where(F.col("kept") < F.col("last"))
    kept = stored(kept.select("digest", "kept", "n"), "kept")
    total = kept.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > F.lit(total)
    with broadcasts(docs.sparkSession) as share:
        rows = _unit_rows(docs, share(build_bloom(kept, "digest", BLOOM_BITS, 4)))
        hot_digests = F.broadcast(kept.where(hot).select("digest", F.lit(True).alias("hot")))  # at most HOT_SHARE rows
        rows = rows.join(hot_digests, "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "tie", "unit"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
        kept = kept.select("digest", "kept", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
        found = rows.join(kept, ["digest", "salt"]).where(rank > F.col("kept"))
        found = found.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set(F.struct("unit", "words", F.col("kept.doc_id").alias("kept_doc_id")))).alias("units"))
        return stored(found, "repeats")


def _going(marks: list[dict], lines: np.ndarray, min_words: int, min_line_words: int | None) -> list[tuple[int, int]]:
    """First and last place in marks (repeated units, in order) of what goes: runs of consecutive
    units with min_words words and, in shorter runs, whole lines with min_line_words words."""
    out, p = [], 0
    while p < len(marks):
        q = p
        while q + 1 < len(marks) and marks[q + 1]["unit"] == marks[q]["unit"] + 1:
            q += 1
        if sum(u["words"] for u in marks[p : q + 1]) >= min_words:
            out.append((p, q))
        elif min_line_words:
            i = p
            while i <= q:
                j, line = i, lines[marks[i]["unit"]]
                while j < q and lines[marks[j + 1]["unit"]] == line:
                    j += 1
                before, after = marks[i]["unit"] - 1, marks[j]["unit"] + 1
                whole = (before < 0 or lines[before] != line) and (after == len(lines) or lines[after] != line)
                if whole and sum(u["words"] for u in marks[i : j + 1]) >= min_line_words:
                    out.append((i, j))
                i = j + 1
        p = q + 1
    return out


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, min_line_words: int | None = MIN_LINE_WORDS) -> DataFrame:
    """docs with the columns text (what is left), removed (array of start, end, kept_doc_id: places
    in characters of the original text and the document that keeps the first unit) and n_removed.

    docs has doc_id, text and any other columns; removed and n_removed are replaced (names that begin
    with "__dedup_" are taken).  Null and empty texts stay as they are.  Rows with equal ids and texts are one document, and keep or lose the same units; rows with
    equal ids and other texts rank by a hash of the text; null ids rank last.  A text that repeats
    others as a whole becomes empty.  Units that touch are removed with the white space after them."""
    docs = docs.drop("removed", "n_removed")
    keyed = docs.withColumn("__dedup_tie", F.xxhash64(F.col("text").cast("string")))
    base = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__dedup_tie").alias("tie"), F.col("text").cast("string").alias("text"))
    found = repeated_units(base).where(F.aggregate("units", F.lit(0), lambda a, u: a + u["words"]) >= min(min_words, min_line_words or min_words))
    found = found.select(F.col("doc_id").alias("__dedup_id"), F.col("tie").alias("__dedup_t"), F.col("units").alias("__dedup_units"))
    joined = keyed.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__dedup_id")) & (F.col("__dedup_tie") == F.col("__dedup_t")), "left")
    names = [c for c in docs.columns if c != "text"]
    span = T.StructType().add("start", "integer").add("end", "integer").add("kept_doc_id", "long")
    schema = T.StructType([*docs.select(*names).schema.fields]).add("text", "string").add("removed", T.ArrayType(span)).add("n_removed", "integer")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, at):
                texts, marks = part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist()
                out, spans = [], []
                hit = [i for i, m in enumerate(marks) if m]
                t = tokens(pa.array([texts[i] for i in hit], pa.string()))
                begin, end, _, of = units(t)
                first = np.searchsorted(of, np.arange(len(hit) + 1))
                breaks = np.concatenate([[0], np.cumsum(t.raw == 0x0A)])
                lines = breaks[t.starts[begin]]
                place = dict(zip(hit, range(len(hit))))
                for i, (text, m) in enumerate(zip(texts, marks)):
                    if not m:
                        out.append(text)
                        spans.append([])
                        continue
                    k = place[i]
                    a, z = int(first[k]), int(first[k + 1])
                    o = int(t.offsets[k])
                    raw = bytes(t.raw[o : int(t.offsets[k + 1])])
                    got, left, at_byte = [], [], 0
                    for p, q in _going(m, lines[a:z], min_words, min_line_words):
                        x = int(t.starts[begin[a + m[p]["unit"]]]) - o
                        nxt = a + m[q]["unit"] + 1
                        y = int(t.starts[begin[nxt]]) - o if nxt < z else len(raw)
                        left.append(raw[at_byte:x])
                        at_byte = y
                        got.append((x, y, m[p]["kept_doc_id"]))
                    left.append(raw[at_byte:])
                    out.append(b"".join(left).decode("utf-8"))
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                    spans.append([{"start": int(chars[x]), "end": int(chars[y]), "kept_doc_id": d} for x, y, d in got])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kept_doc_id", pa.int64())]))
                cols = [part.column(j) for j, n in enumerate(part.schema.names[:-1]) if j != at]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string()), pa.array(spans, kind), pa.array([len(s) for s in spans], pa.int32())], [*names, "text", "removed", "n_removed"])

    return joined.select(*docs.columns, "__dedup_units").mapInArrow(cut, schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose something: what is left of them and what went."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).where("n_removed > 0")
