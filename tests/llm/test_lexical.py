import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quarrylane.llm import lexical
from quarrylane.llm.common import broadcasts, stored

from .brute import LOWER

DOCS = "doc_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranked(docs, items, k):
    """docs, items: lists of (id, text); rows in order, null ids last in ties."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n_docs, n_words = len(bags), sum(n for _, _, n in bags)
    df = Counter(w for _, b, _ in bags for w in b)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, b, n in bags:
            m = 50 + 50 * n * n_docs // n_words
            score = sum(w[t] * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if t in b)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def world():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)] + ["Ärger", "naïve", "日本", "x9"]
    pick = lambda n: rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n)
    docs = [(3 * i, rng.choice([" ", ", ", "_"]).join(pick(rng.randint(1, 90)))) for i in range(260)]
    docs += [(i, docs[7][1]) for i in range(1, 60, 3)]  # ties
    docs += [(1000, None), (1001, ""), (1002, " -- "), (1003, " ".join(pick(20_000))), (None, "w1 w2 w3"), (None, docs[3][1]), (4, docs[4][1]), (4, docs[4][1])]
    items = [(i, " ".join(pick(rng.randint(1, 25)))) for i in range(25)] + [(90, None), (91, ""), (92, "unseen"), (93, "W0 w0"), (7, "w5 w6"), (7, "w5 w6"), (None, "w9 w399"), (94, docs[7][1]), (95, " ".join(words))]
    return docs, items


@pytest.mark.parametrize("k, shard, block", [(10, 3000, 200), (50, 8 << 20, 1 << 16), (1, 1, 1 << 16)])
def test_search_equals_brute_force(spark, world, k, shard, block):
    docs, items = world
    got = lexical.ranked_search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string"), k, shard, block)
    assert rows(got) == sorted(ranked(docs, items, k), key=str)


def test_sql_equals_brute_force(world):
    docs, items = [d for d in world[0] if d[0] is not None], [i for i in world[1] if i[0] is not None][:29]
    con = duckdb.connect()
    for name, key, own in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", own)
    cur = con.execute(lexical.ORACLE)
    assert sorted(cur.fetchall(), key=str) == sorted(ranked(docs, items, 50), key=str)


def test_odd_tables(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", 3, "x")], "doc_id int, text string, rank int, item_id string")
    items = spark.createDataFrame([(5, "b", 1)], "item_id int, text string, doc_id int")
    assert lexical.ranked_search(none, items).count() == 0
    assert lexical.ranked_search(one, items.limit(0)).count() == 0
    assert rows(lexical.ranked_search(one, items)) == ranked([(1, "a b")], [(5, "b")], 50)


def test_long_documents_keep_within_64_bits():
    m = lexical.Model(10**12, 10**15, np.array([5]))
    words = np.array([10, 10**9], np.int64)
    assert m.lengths(words).tolist() == [50 + 50 * n * 10**12 // 10**15 for n in words.tolist()]


def test_pairs_tighten_the_bounds_and_skip(spark, world):
    docs, items = world
    index = stored(lexical.build_index(spark.createDataFrame(docs, DOCS).repartition(2), 4000), "index")
    block = next(lexical._blocks(lexical.item_terms(spark.createDataFrame(items[:25], "item_id long, text string")), 1 << 16))
    n_docs, n_words = (sum(r[i] for r in index.select("n_docs", "n_words").collect()) for i in (0, 1))
    with broadcasts(spark) as share:
        vocabulary = share(np.unique(np.concatenate([t for _, t in block])))
        df = lexical.document_counts(index, vocabulary, len(vocabulary.value))
        model = lexical.Model(n_docs, n_words, np.array([lexical.weight(n_docs, int(x)) if x else 0 for x in df]))
        plan = lexical.plan_block(block, index, vocabulary, model, 5)
        best = {(i, r): s for i, r, _, s in ranked(docs, items[:25], 5)}
        shards = list(lexical.Shard.rows(iter(index.toArrow().combine_chunks().to_batches()), vocabulary.value))
    tighter = looked = posted = 0
    for item, terms_, single, joint, least in zip(plan.item_ids, plan.terms, plan.single, plan.joint, plan.least):
        # Thresholds from the histograms are reached by k documents; bounds hold for every document.
        assert least <= best.get((item, 5), 0)
        every = lexical.bounds(np.ones(len(terms_), bool), single, joint)
        assert (every[:-1] <= np.cumsum(single[::-1])[::-1]).all() and every[0] >= best[item, 1]
        tighter += every[0] < single.sum()
        threshold = best.get((item, 5), 1)
        for s in shards:
            lengths = model.lengths(s.words)
            impact = lambda v: model.impacts(v, s.counts[s.at[v] : s.end[v]], lengths[s.docs[s.at[v] : s.end[v]]])  # noqa: B023, E731
            seen = []

            def some(v, at):
                seen.append(len(at))  # noqa: B023
                return impact(v)[at]  # noqa: B023

            def full(v):
                seen.append(s.end[v] - s.at[v])  # noqa: B023
                return impact(v)  # noqa: B023

            exact = np.zeros(len(s.words), np.int64)
            for v in terms_:
                exact[s.docs[s.at[v] : s.end[v]]] += impact(v)
                posted += s.end[v] - s.at[v]
            here = s.end[terms_] > s.at[terms_]
            bound = lexical.bounds(here, single, joint)
            assert bound[0] >= exact.max(initial=0)
            if bound[0] >= threshold:
                docs_, scores = lexical.search_shard(s, terms_, bound, threshold, full, some)
                assert docs_.tolist() == np.flatnonzero(exact >= threshold).tolist() and (scores == exact[docs_]).all()
            looked += sum(seen)
    assert tighter > 15 and looked < 0.7 * posted
