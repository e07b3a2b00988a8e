"""Licence scan: an Aho-Corasick automaton finds phrases and tags, a shunting-yard parser reads
the licence expressions that follow tags."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases, in words.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "neither the name of": "bsd-3-clause",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license": "bsl-1.0",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0-1.0",
    "licensed under mit": "mit",
    "all rights reserved": "proprietary",
}
#: Words before an expression, such as "SPDX-License-Identifier: MIT OR Apache-2.0".
TAG = "spdx license identifier"
#: Licences that let one use the text; a document's score is that of what it may be used under.
PERMISSIVE = frozenset("mit apache-2 apache-2.0 bsd bsd-2-clause bsd-3-clause isc cc-by cc-by-4.0 cc0-1.0 unlicense bsl-1.0 zlib".split())
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKEN = re.compile(rb"[ \t]*(\(|\)|[A-Za-z0-9.+:-]+)")
_BEFORE = re.compile(rb"[: \t]*")
_OPS = {"or": 1, "and": 2, "with": 3}


def parse_expression(data: bytes, place: int = 0) -> tuple[list[str], float] | None:
    """Reads the longest licence expression of a line from a place on: its licence names (lower case,
    an exception joined by ' with ') and its score. `or` takes the best side, `and` the worst.
    None when there is no expression or its operators don't fit together.  Only the expression is
    looked at, not the rest of the line."""
    out: list[tuple[list[str], float]] = []
    ops: list[str] = []
    want = True  # an operand comes next

    def reduce() -> bool:
        op = ops.pop()
        if len(out) < 2:
            return False
        (rn, rs), (ln, ls) = out.pop(), out.pop()
        if op == "with":
            if len(ln) != 1 or len(rn) != 1:
                return False
            out.append(([f"{ln[0]} with {rn[0]}"], ls))
        else:
            ln += rn
            out.append((ln, max(ls, rs) if op == "or" else min(ls, rs)))
        return True

    while m := _TOKEN.match(data, place):
        t = m[1].decode().lower()
        if t == "(" and want:
            ops.append(t)
        elif t == ")" and not want and "(" in ops:
            while ops[-1] != "(":
                if not reduce():
                    return None
            ops.pop()
        elif t in _OPS and not want:
            while ops and ops[-1] != "(" and _OPS[ops[-1]] >= _OPS[t]:
                if not reduce():
                    return None
            ops.append(t)
            want = True
        elif want and t not in _OPS and t not in "()":
            name = t.rstrip(".:-")
            if not name:
                return None
            out.append(([name], 1.0 if name in PERMISSIVE else 0.0))
            want = False
        else:
            break
        place = m.end()
    if want and ops and ops[-1] in _OPS:  # a trailing operator belongs to the prose after it
        ops.pop()
    while ops:
        if ops[-1] == "(" or not reduce():
            return None
    return out[0] if len(out) == 1 else None


def _automaton(phrases: Mapping[str, tuple]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, value in phrases.items():
        a.add_word(f" {phrase} ".encode().decode("latin-1"), (len(phrase.split()), value))
    a.make_automaton()
    return a


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, base: Mapping[str, str] = BASE, notices: Mapping[str, str] = NOTICES, tag: str = TAG) -> DataFrame:
    """One row for each row of docs (doc_id, text), in one pass without a shuffle.

    Words are runs of a-z, 0-9 and non-ASCII characters after A-Z is lower-cased; a phrase counts
    wherever its words stand one after another, also where places overlap.  base_labels come from
    `base` alone, labels from all phrases and from the expressions after `tag`.  score is 1 when the
    text names no licence, else the worst of what its notices and expressions allow: 1 for
    permissive licences, 0 for others.  Null and empty texts have no words, null places, empty
    labels and score 1.  Null ids, repeated rows and other columns do no harm.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton({**{p: ("notice", x) for p, x in notices.items()}, **{p: ("base", x) for p, x in base.items()}, tag: ("tag", "")})
        for batch in batches:
            for part in slices(batch, 1):
                cols: list[list] = [[] for _ in range(8)]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    low = (text or "").encode("utf-8", "surrogatepass").lower()
                    words = _WORDS.findall(low)
                    flat = b" " + b" ".join(words) + b" "
                    hits = [(end, *value) for end, value in found.iter(flat.decode("latin-1"))]
                    starts, kept, scores, at, n = [], {"base": set(), "notice": set()}, [], 0, 0
                    spans = None
                    for end, size, (kind, label) in hits:
                        n += flat.count(b" ", at, end + 1)
                        at = end + 1
                        start = n - 1 - size
                        if kind == "base":
                            starts.append(start)
                        if kind == "tag":
                            spans = spans or [m.end() for m in _WORDS.finditer(low)]
                            begin = _BEFORE.match(low, spans[start + size - 1]).end()
                            if parsed := parse_expression(low, begin):
                                kept["notice"].update(parsed[0])
                                scores.append(parsed[1])
                        else:
                            kept[kind].add(label)
                            scores.append(1.0 if label in PERMISSIVE else 0.0)
                    row = (doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(kept["base"])), ",".join(sorted(kept["base"] | kept["notice"])), min(scores, default=1.0))
                    for c, v in zip(cols, row):
                        c.append(v)
                types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(scan, SCHEMA)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
