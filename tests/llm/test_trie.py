import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from quarrylane.llm import conversation_trie as trie

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(base, [])[:h] + t[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, rows, parts=3):
    df = trie.conversation_trie(spark.createDataFrame(rows, TURNS).repartition(parts))
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def talk(seed, n, odd=True):
    rng = random.Random(seed)
    texts = ["a", "bb", "ccc", "é🙂", "", "x" * 40 + "1", "x" * 40 + "2"]
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(0, 420), rng.choice([0, 100, 200]), rng.randrange(-230, 0)])
        for t in range(rng.choice([1, 2, 3, 8])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant"]), rng.choice(texts)))
    if odd:
        rows += [(None, 1, "user", "lost"), (5, None, None, None), (5, 7, "", None), (5, 7, None, ""), (6, 1, "user", "a"), (6, 1, "user", "a"), (2**62, 0, "user", "a"), (-(2**62), 3, "u", "z")]
    # Equal numbers, roles and first 32 code points: any order will do, so the tables have none of them.
    seen = {}
    return [r for r in rows if seen.setdefault((r[0], r[1], r[2] or "", (r[3] or "")[:32]), r[3]) == r[3]]


@pytest.mark.parametrize("seed", [1])
def test_nodes_equal_brute_force(spark, seed):
    rows = talk(seed, 150)
    assert nodes(spark, rows) == brute(rows)


def test_long_copied_and_hot_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 7)
    monkeypatch.setattr(trie, "PIECE_BITS", 2)
    monkeypatch.setattr(trie, "HOT_SHARE", 20)
    rows = [(100, t, "user", f"t{t % 5}") for t in range(900)] + [(c, t, "user", f"t{t % 5}") for c in (101, 102, 300) for t in range(60)]
    rows += [(c, 0, "user", "hello") for c in range(1000, 1400)] + [(c, 1, "user", f"only {c}") for c in range(1000, 1300)]
    assert nodes(spark, rows) == brute(rows)


def test_one_turn_repeated(spark):
    rows = [(7, None, "user", "again")] * 500 + [(9, 1, "user", "x")]
    assert nodes(spark, rows) == brute(rows)


def test_references_lead_to_the_last_turn(spark):
    rows = talk(3, 60, odd=False)
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role, text))
    own = {c: sorted(t) for c, t in own.items()}
    got = trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    for r in got:
        if r.depth:
            c, h = r.conv_id, zlib.crc32(str(r.conv_id).encode()) % 6
            base = c - (c % 100 if c >= 0 else -(-c % 100))
            built = own.get(base, [])[:h] + own[c][h:]
            assert own[r.turn_conv_id][r.turn_place] == built[r.depth - 1]


def test_sql_equals_brute_force():
    rows = talk(4, 80)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cur = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({trie.ORACLE})")
    assert sorted(cur.fetchall(), key=str) == brute(rows)


def test_odd_tables(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "user", "x")]) == []
    # Turnless: five own turns at most are replaced by a head that isn't there.
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 5)
    assert nodes(spark, [(c, 0, "user", "x")]) == brute([(c, 0, "user", "x")]) != []
    wide = spark.createDataFrame([(1, 0, "u", "a", 5, "z")], "conv_id int, turn int, role string, text string, d int, c string")
    assert [tuple(r) for r in trie.conversation_trie(wide).select(COLUMNS).collect()] != []


def test_equal_numbers_are_noticed(spark, monkeypatch):
    rows = talk(5, 30)
    turns, tried = trie._turns, []

    def clash(conversations, seed):
        tried.append(seed)
        out = turns(conversations, seed)
        return out.selectExpr("c", "turn", "role", "text", *(["1L AS s1", "1L AS s2"] if seed == 0 else ["s1", "s2"]))

    monkeypatch.setattr(trie, "_turns", clash)
    assert nodes(spark, rows) == brute(rows) and tried == [0, 1]
    # A base of 1 does not see the order of turns; the groups' checks do.
    monkeypatch.setattr(trie, "_turns", turns)
    monkeypatch.setattr(trie, "_bases", lambda seed, f=trie._bases: [1, 1] if seed == 0 else f(seed))
    rows = [(1000 + i, t, "user", x) for i, xs in enumerate(["abcdefgh", "bacdefgh"] * 20) for t, x in enumerate(xs)]
    assert nodes(spark, rows) == brute(rows)


def test_products_modulo_the_prime():
    rng = random.Random(1)
    p = trie.PRIME
    a = [rng.choice([0, 1, p - 1, rng.randrange(p)]) for _ in range(500)]
    b = [rng.choice([0, 1, p - 1, rng.randrange(p)]) for _ in range(500)]
    assert trie.times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % p for x, y in zip(a, b)]
    first = np.repeat([0, 200, 450], [200, 250, 50])
    place = np.arange(500) - first + np.where(first == 0, 1000, 0)
    got = trie.running_products(np.array(a, np.uint64), first, place, 12345, 77).tolist()
    for i in range(500):
        want = sum(a[j] * pow(12345, int(place[j]), p) for j in range(first[i], i + 1)) + (77 if first[i] == 0 else 0)
        assert got[i] == want % p
