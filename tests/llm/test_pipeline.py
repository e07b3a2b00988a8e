import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylane.llm.queries import ORACLES, QUERIES

from . import brute
from .test_ops import DOCS, edited, prose

SCHEMA = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark that hold each planted case."""
    rng = random.Random(11)
    d = str(tmp_path_factory.mktemp("sf"))
    item, passage = prose(rng, 40), prose(rng, 70) + "."
    rows, labels = [], []

    def put(text, kind):
        rows.append((len(rows), text, "en", f"s{len(rows) % 3}" if len(rows) % 11 else None, len(text or "")))
        kinds.setdefault(kind, []).append(rows[-1][0])

    kinds: dict[str, list[int]] = {}
    for _ in range(120):
        put(prose(rng, rng.randint(60, 120)), "clean")
    for i in range(60):
        w = prose(rng, 60).split(" ")
        for bad in rng.sample(["moron", "idiot", "scum", "trash"], 2):
            w.insert(rng.randrange(len(w)), bad)
        put(" ".join(w), "toxic")
    for i in range(4):
        put(rows[i][1], "copy")
        put(edited(rng, rows[i][1] + " " + prose(rng, 1), 1), "near")
    for _ in range(4):
        put(prose(rng, 30) + ". " + passage + " " + prose(rng, 30), "repeat")
        put(prose(rng, 30) + " " + item + " " + prose(rng, 30), "leak")
    put(None, "null"), put("", "empty"), put("long " * 20_000, "long")
    for i, *_ in rows:
        if i % 2 == 0 and i < 180:
            labels.append((i, 1, int(i in set(kinds["toxic"]))))
    spark.createDataFrame(rows, DOCS).withColumn("extra", F.lit(1)).drop("extra").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item), (1, "short one")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, kinds, passage


def test_stages_one_by_one(spark, folder, tmp_path):
    d, rows, kinds, passage = folder
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.dtypes == SCHEMA
        kept.append({r.doc_id: r for r in docs.collect()})
    tox, near, cut, clean, mixed = kept
    assert not set(kinds["toxic"]) & set(tox) and set(kinds["clean"]) <= set(tox)
    want = brute.components([(r.doc_id, r.text) for r in tox.values()], 5, 4, 5)
    assert set(near) == {k for k, (n, c) in want.items() if n == 0 or c == k}
    assert not set(kinds["copy"]) & set(near)
    left = brute.dedup({r.doc_id: r.text for r in near.values() if r.text}, 25)
    assert {k: cut[k].text for k in left} == {k: v[0] for k, v in left.items()} and set(cut) == set(near)
    assert sum(passage in (r.text or "") for r in cut.values()) == 1
    assert set(clean) == set(cut) - set(kinds["leak"])
    assert set(mixed) == set(clean) and all(r.taken <= 3 * r["size"] for r in mixed.values())


def test_run_equals_the_stages_and_repeats(spark, folder):
    a = sorted(map(str, corpus_pipeline.run(spark, folder[0]).collect()))
    assert a and a == sorted(map(str, corpus_pipeline.run(spark, folder[0]).collect()))


def test_stages_on_odd_tables(spark, folder):
    d = folder[0]
    odd = [(None, None, None, None, None), (1, None, None, None, None), (1, "same words " * 20, "en", None, 220), (1, "same words " * 20, "en", None, 220), (None, "text without an id", None, "s", 3)]
    for rows in ([], odd):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, spark.createDataFrame(rows, DOCS), d).count() >= 0


def test_registry():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
