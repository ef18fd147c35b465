import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from trustmill.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos int, key string, cls string"


def brute(rows, bases=100, heads=6):
    """Every prefix of every rebuilt conversation as a key."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    nodes = defaultdict(list)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % bases) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(rebuilt[c]) + 1):
            nodes[rebuilt[c][:d]].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        saved[p] = (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in children[p])
    return sorted(
        (min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(p)).encode()).hexdigest())
        for p, cs in nodes.items()
    )


def found(spark, rows, **parts):
    df = spark.createDataFrame([(*r, 0, "x", None) for r in rows], SCHEMA).repartition(3)
    got = prefix_trie.trie(df, **parts)
    assert got.columns == prefix_trie.NODE
    return sorted(tuple(r) for r in got.collect())


ODD = [
    (100, None, "user", "first"), (100, 1, "user", "hi"), (100, 1, "user", "hi"), (100, 1, None, None), (101, 1, "user", "hi"), (101, 2, "bot", "😀 long"), (None, 1, "user", "lost"),
    (250, 1, "user", "no base"), (250, 2, "bot", ""), (-101, 1, "user", "hi"), (-100, 1, "user", "hi"), (-100, 2, "bot", "x"), (103, 5, "a", "bc"), (104, 5, "ab", "c"), (105, 1, "user", "x" * 100_000), (106, 1, "user", "x" * 100_000), (0, 0, "user", "zero"),
]


def test_odd_rows(spark):
    assert found(spark, ODD) == brute(ODD)
    assert found(spark, [(7, 1, "a", "b")]) == brute([(7, 1, "a", "b")])
    assert found(spark, []) == [] and found(spark, [(None, 1, "a", "b")]) == []


@pytest.mark.parametrize("seed", range(3))
def test_random_tries(spark, seed, monkeypatch):
    """Few different turns, so that classes split, end and go on at many depths; runs of two ids."""
    monkeypatch.setattr(prefix_trie, "RUN", 2)
    r = random.Random(seed)
    rows = [(c, t, r.choice("ab"), r.choice(["", "yes", "no"])) for c in range(0, 330, 1 + seed) for t in range(r.randint(1, 7))]
    assert found(spark, rows) == brute(rows)


def test_long_equal_conversations_take_few_rounds(spark, monkeypatch):
    calls = []
    real = prefix_trie._split
    monkeypatch.setattr(prefix_trie, "_split", lambda *a: calls.append(1) or real(*a))
    rows = [(c, t, "u", f"turn {t if t < 60 or c % 2 else -t}") for c in range(100, 108) for t in range(70)] + [(109, 1, "u", "same")] * 40
    assert found(spark, rows) == brute(rows)
    assert len(calls) <= 8


def test_sql_agrees(spark, tmp_path, sf_dir):
    con = duckdb.connect()
    rows = ODD[:-1]
    spark.createDataFrame([(*r, 0, "x", None) for r in rows], SCHEMA).write.parquet(str(tmp_path / "c"))
    con.sql(f"create view conversations as select * from '{tmp_path}/c/*.parquet'")
    assert sorted(con.sql(prefix_trie.oracle()).fetchall()) == brute(rows)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    want = brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert sorted(con.sql(prefix_trie.oracle()).fetchall()) == want == sorted(tuple(r) for r in prefix_trie.trie(table).collect())
