import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trustmill.llm import components, licences, ngram_join, queries, vectors

from .conftest import words


def grams(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_classes(rows, n, percent):
    root = {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    sets = [(i, grams(t, n)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def family(seed, size, copies, changes):
    r = random.Random(seed)
    base = words(seed, size).split()
    out = []
    for _ in range(copies):
        new = list(base)
        for _ in range(r.randint(0, changes)):
            new[r.randrange(size)] = f"z{r.randrange(10**6)}"
        out.append(" ".join(new))
    return out


def fixture_rows():
    passage = words(77, 30)
    texts = [None, "", "  \n", "one", "ONE", "one two", "One Two\n", "a b c d", "A b c d", "é É"]
    for seed in range(6):
        texts += family(seed, 40 + 30 * seed, 12, 1 + seed)
    texts += [f"{words(200 + k, 20 + 5 * k)} {passage} {words(300 + k, 30)}" for k in range(25)]
    texts += [words(5, 60)] * 9
    return list(enumerate(texts))


@pytest.mark.parametrize(("n", "percent", "ids"), [(4, 85, 1 << 12), (5, 80, 64)])  # with 64 bits most ids share one
def test_classes_equal_brute_force(spark, monkeypatch, n, percent, ids):
    monkeypatch.setattr(ngram_join, "CHUNK_ROWS", 5)
    monkeypatch.setattr(ngram_join, "HOT_AT", 6)
    monkeypatch.setattr(ngram_join, "IDS", ids)
    monkeypatch.setattr(ngram_join, "PAGE", 32)
    rows = fixture_rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, size int, first string").repartition(4)
    want = brute_classes(rows, n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(docs, n, percent).collect()}
    assert got == want
    kept = ngram_join.representatives(docs, n, percent)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}


def test_texts_that_share_passages_with_many_others_are_no_block(spark, monkeypatch):
    r = random.Random(3)
    deals = [r.sample(range(240), 240) for _ in range(4)]  # every passage is in two texts, other two each time
    rows = [(i, " ".join(words(10_000 * c + deal[i] // 2, 15) for c, deal in enumerate(deals))) for i in range(240)]
    rows += list(enumerate(family(9, 60, 6, 2), 240))
    largest, whole = [], ngram_join._in_block
    monkeypatch.setattr(ngram_join, "_in_block", lambda rows, percent: largest.append(rows.groupBy("block").agg(F.countDistinct("doc_id").alias("n")).agg(F.max("n")).first()[0]) or whole(rows, percent))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute_classes(rows, 4, 85) and largest[0] < 60


@pytest.mark.parametrize("percent", [85, 80])
def test_linked_sets_have_more_equal_parts_than_are_left_out(percent):
    r = np.random.default_rng(percent)
    for _ in range(2000):
        b = r.integers(-(2**63), 2**63 - 1, int(r.integers(4, 400)))
        a = np.concatenate([b[int(r.integers(0, ngram_join.spare(len(b), percent) + 1)) :], r.integers(-(2**63), 2**63 - 1, int(r.integers(0, max(1, len(b) // 8))))])
        a, b = np.unique(a), np.unique(b)
        shared = len(np.intersect1d(a, b))
        if 100 * shared < percent * (len(a) + len(b) - shared) or len(a) == len(b) == shared:
            continue
        band = ngram_join.size_band(max(len(a), len(b)), percent)
        assert ngram_join.size_band(min(len(a), len(b)), percent) in (band - 1, band)
        n, out = ngram_join.dealt_parts(band, percent)
        assert (ngram_join.part_hashes(a, band, n) == ngram_join.part_hashes(b, band, n)).sum() > out


@pytest.mark.parametrize("cross", [False, True])
def test_a_dense_block_is_connected_as_by_brute_force(cross):
    r = np.random.default_rng(4)
    bases = [np.unique(r.integers(-(2**63), 2**63 - 1, 200)) for _ in range(3)]
    sets = []
    for k in range(150):
        s = bases[k % 3].copy()
        s[r.choice(200, int(r.integers(0, 20)), replace=False)] = r.integers(-(2**63), 2**63 - 1, 1)
        sets.append(np.unique(s))
    chunk = [k // 3 % 2 if cross else 0 for k in range(150)]
    lives = [bool(k % 5) for k in range(150)]

    def joined(pairs):
        root = list(range(150))
        for a, b in pairs:
            x, y = sorted((root[a], root[b]))
            root = [x if z == y else z for z in root]
        return root

    linked = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))
    want = [(a, b) for a in range(150) for b in range(a) if (lives[a] or lives[b]) and not (cross and chunk[a] == chunk[b]) and linked(a, b)]
    assert joined(ngram_join.block_links(list(range(150)), sets, lives, chunk, 85)) == joined(want)


def test_odd_tables(odd, empty):
    rows = ngram_join.classes(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.doc_id == 11} == {10}
    assert ngram_join.classes(empty).count() == 0 and ngram_join.representatives(empty).count() == 0


def test_ngram_rows_with_one_id_and_without(spark):
    a, b = words(1, 50), words(2, 50)
    rows = [(3, a), (3, b), (3, a), (None, a), (None, None), (4, b + " end"), (1, a.upper()), (2, ""), (5, words(3, 30_000)), (6, words(3, 30_000) + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", F.lit("x"))
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.classes(docs, 4, 85).collect()), key=str)
    assert got == sorted([(3, 1), (3, 3), (3, 1), (None, None), (None, None), (4, 3), (1, 1), (2, 2), (5, 5), (6, 5)], key=str)


def test_bounds_never_lose_a_pair():
    r = random.Random(8)
    base = r.sample(range(10**9), 120)
    sets = []
    for _ in range(150):
        own = [x if r.random() > r.choice((0.02, 0.1, 0.3)) else r.randrange(10**9) for x in base[: r.randint(60, 120)]]
        sets.append(np.unique(np.array(own, np.int64)))
    sizes = np.array([len(s) for s in sets])
    counts = np.stack([np.bincount(s % 64, minlength=64) for s in sets]).astype(np.uint16)
    tree = ngram_join.CountTree(counts, sizes, 80)
    for k, s in enumerate(sets):
        near = set(tree.query(counts[k], len(s)).tolist())
        linked = {j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))}
        assert linked <= near


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(5, 5), (7, 8), (7, 8)]
    root = list(range(200))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.node: x.component for x in components.components(spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_licences_equal_sql(spark, tmp_path):
    notices = list(licences.TEMPLATES.values())
    texts = [None, "", "no licence here", "\n".join(notices), "Some text. " + notices[0] + " More text.", notices[1].upper(), "by the license under license", *notices]
    texts += ["Licensed under the Apache License, Version 2.0, as of now", "released under the mit licence", "x y " * 2000 + "\n" + notices[4] + "\n" + notices[4]]
    texts += [" ".join([notices[12]] * 3), " ".join([notices[12].rstrip(".")] * 9)]  # one line of the same words again
    docs = spark.createDataFrame([*enumerate(texts), (2, "again"), (2, notices[0]), (2, notices[0]), (None, notices[1]), (None, None)], "doc_id long, text string").withColumn("score", F.lit("x"))
    assert licences.scan(docs.limit(0)).count() == 0
    docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    order = lambda r: (r[0] is not None, r[0], str(r[1:]))
    want = sorted(con.sql(licences.oracle()).fetchall(), key=order)
    got = sorted(map(tuple, licences.scan(docs).select("doc_id", "licence", "score", "licences", "n_units").collect()), key=order)
    assert got == want
    got = sorted((r for r in got if r[0] not in (None, 2)), key=lambda r: r[0])
    got[2:2] = [None]
    assert [r[1] for r in got[7 : 7 + len(notices)]] == sorted(licences.TEMPLATES)
    plan = licences.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_real_licence_texts(spark):
    full = {f"{name} {k}": (name, text) for k, (name, text) in enumerate(licences.long_texts())}
    prose = "alpha beta gamma delta epsilon zeta eta theta\n" * 30
    rows = [(name, text) for name, text in full.values()]
    rows += [(name, prose + text + prose) for name, text in full.values()]
    rows += [(name, " ".join(text.split())) for name, text in full.values()]
    rows += [("Apache-2.0", "\n".join(f" * {line}" for line in text.splitlines())) for name, text in full.values() if name == "Apache-2.0"]
    rows += [("BSD-3-Clause", "x\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\ny")]
    rows += [(None, prose), (None, "the license, the software and the permission of this copyright notice")]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert [got[i].licence for i in range(len(rows))] == [name for name, _ in rows]
    assert all(got[i].licences == (name or "") and got[i].n_units >= (name is not None) for i, (name, _) in enumerate(rows))
    twice = spark.createDataFrame([(0, 2 * (prose + dict(licences.long_texts())["ISC"] + prose))], "doc_id long, text string")
    assert licences.scan(twice).first().n_units == 2


def test_key_words_are_in_every_match():
    for text in licences.TEMPLATES.values():
        grams_ = licences.template_bigrams(text)
        keys = set(licences.key_words(grams_))
        avoiding = [g for g in grams_ if not keys & set(g.split())]
        assert 2 * len(avoiding) < licences.THRESHOLD * (len(avoiding) + len(grams_))


def test_vectors_equal_brute_force(spark, monkeypatch):
    r = np.random.default_rng(3)
    centres = r.normal(size=(60, 24))
    x = np.repeat(centres, 10, axis=0) + r.normal(size=(600, 24)) * 0.15
    x[:40] = x[0] + r.normal(size=(40, 24)) * 0.01
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(700, x[0].astype(np.float32).tolist()), (701, None), (702, [0.0] * 24), (703, [float("nan")] * 24), (704, []), (705, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "l") for i, v in rows], "vec_id long, embedding array<float>, v string").repartition(5)
    got = {g.vec_id: g for g in vectors.near_duplicates(df, 0.9, shard_rows=150).collect()}
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i < 701}
    unit = np.stack([v / np.linalg.norm(v) for v in good.values()])
    ids, near = list(good), unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert {i: got[i].n_links for i in ids} == {i: int(n) for i, n in zip(ids, near.sum(axis=1), strict=True)}
    root = dict(zip(ids, ids, strict=True))
    for _ in ids:
        for k in range(len(ids)):
            root[ids[k]] = min([root[ids[k]], *(root[ids[j]] for j in np.flatnonzero(near[k]))])
        if all(root[ids[k]] == root[ids[j]] for k in range(len(ids)) for j in np.flatnonzero(near[k])):
            break
    assert {i: got[i].component_id for i in ids} == root and all(g.kept == (g.vec_id == g.component_id) for g in got.values())
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(701, 706)) and all(g.recall >= vectors.RECALL for g in got.values())
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (7, [0.99, 0.01, 0.0]), (7, [0.99, 0.01, 0.0]), (None, [0.98, 0.02, 0.0]), (None, [0.0, 0.0, 1.0]), (None, None), (9, [0.0, -0.0, 2.0]), (9, [1e-30, 0.0, 1e30])]
    got = vectors.near_duplicates(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, digest string")).collect()
    assert sorted(((g.vec_id, g.n_links, g.component_id, g.kept) for g in got), key=str) == sorted([
        (5, 3, 5, True), (5, 0, 5, True), (7, 3, 5, False), (7, 3, 5, False), (None, 3, 5, False), (None, 2, 9, False), (None, 0, None, True), (9, 2, 9, True), (9, 2, 9, True),
    ], key=str)


def test_no_pairs_leave_a_task():
    """A dense group gives a forest and degrees, and both directions of a search count."""
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=16) + r.normal(size=(300, 16)) * 0.02, r.normal(size=(200, 16))])
    shards = []
    for rows in (slice(0, None, 2), slice(1, None, 2)):
        shard = vectors.Shard.__new__(vectors.Shard)
        shard.unit = vectors._unit(x[rows])
        shard.nodes, shard.copies, shard.beam, shard.graph = np.arange(500)[rows], np.full(250, 2), 32, vectors.SmallWorld(shard.unit)
        shards.append(shard)
    unit = vectors._unit(x)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    total, forest = np.zeros(500, int), []
    for a, b in ((0, 0), (0, 1), (1, 1)):
        degrees, own = vectors.met(shards[a], shards[b], 0.9)
        assert len(own) < 250 * (1 + (a != b))
        forest += own
        for node, n in degrees.items():
            total[node] += n
    assert (total == 2 * near.sum(axis=1)).all()
    root = np.arange(500)
    for a, b in forest:
        root[root == root[a]] = root[b]
    for k in range(500):
        assert set(np.flatnonzero(near[k])) <= set(np.flatnonzero(root == root[k]))
    assert all(near[a, b] for a, b in forest)


def test_pairs_of_shards_are_tasks_of_their_own(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(i, 1, v.astype(np.float32).tobytes(), 8) for i, v in enumerate(r.normal(size=(90, 8)))]
    built = vectors.graphs(spark.createDataFrame(rows, "node long, copies long, v binary, d int"), 0.9, 30)
    assert built.rdd.getNumPartitions() >= 12
    built = vectors.stored(built, "test-graphs")
    assert built.count() == 3 and vectors.links(built, 0.9).rdd.getNumPartitions() >= 24
    shard, asked = vectors.Shard(built.first().graph), []
    monkeypatch.setattr(vectors.Shard, "links", lambda self, other, threshold: asked.append(other) or iter(()))
    assert vectors.met(shard, shard, 0.9) == ({}, []) and len(asked) == 1


def test_graph_holds_distinct_links_and_finds_neighbours():
    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(size=(1500, 16)), np.ones(16) + r.normal(size=(900, 16)) * 0.05])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = vectors.SmallWorld(x[r.permutation(len(x))])
    for level, links in enumerate(graph.links):
        assert (links[np.setdiff1d(np.arange(len(x)), graph.members[level])] < 0).all()
        for node, row in enumerate(links):
            own = row[row >= 0]
            assert len(set(own.tolist())) == len(own) and node not in own
    # many searches at once, each with beams of its own
    true = graph.x[:600] @ graph.x.T >= 0.9 + 1e-5
    found = graph.above(graph.x[:600], 0.9, 32)
    assert sum(len(np.intersect1d(f, np.flatnonzero(t))) for f, t in zip(found, true, strict=True)) >= 0.98 * true.sum()


def test_vectors_without_a_link_to_them_are_found():
    r = np.random.default_rng(10)
    x = np.concatenate([r.normal(size=(3000, 16)), np.ones(16) + r.normal(size=(40, 16)) * 0.05, np.arange(16) + r.normal(size=(200, 16)) * 0.05])
    graph = vectors.SmallWorld(x / np.linalg.norm(x, axis=1, keepdims=True))
    own = np.arange(3000, 3240)
    lone = own[::9]  # as those that no node of a dense group keeps among its closest
    graph.links[0][np.isin(graph.links[0], lone)] = -1
    queries = (graph.x[own] + r.normal(size=(240, 16)) * 0.001).astype(np.float32)
    true = [np.flatnonzero(near).tolist() for near in queries @ graph.x.T >= 0.9 - 1e-5]
    asked, compared = graph._search, []
    graph._search = lambda queries, level, beam, start: compared.append(beam) or asked(queries, level, beam, start)
    assert [sorted(f.tolist()) for f in graph.above(queries, 0.9, 32)] == true and max(compared) == 32
    # 200 nodes have more links than the graph has nodes, 40 have not
    found = np.arange(240) * len(x) + np.where(np.arange(240) < 40, 3001, 3041)
    assert graph._spread(queries, found, np.float32(0.9))[1].tolist() == [False] * 40 + [True] * 200
    # a beam that would meet all vectors is no search
    compared.clear()
    beam, recall = vectors.audited_beam(graph, 0.9, queries=queries, own=np.full(240, -1))
    assert (beam, recall) == (32, 1.0)
    graph.links[0][:] = -1
    del graph.neighbours
    compared.clear()
    assert vectors.audited_beam(graph, 0.9, queries=queries, own=np.full(240, -1)) == (len(x), 1.0) and max(compared) < len(x) / 24


def test_graphs_depend_on_vectors_alone(spark):
    r = np.random.default_rng(11)
    data = [v.astype(np.float32).tobytes() for v in r.normal(size=(300, 8))]
    parts = []
    for nodes in (range(300), r.permutation(300).tolist()):
        rows = sorted((i, 1, v, 8) for i, v in zip(nodes, data, strict=True))
        built = vectors.graphs(spark.createDataFrame(rows, "node long, copies long, v binary, d int"), 0.9, 100).collect()
        shards = [vectors.Shard(row.graph) for row in sorted(built, key=lambda row: row.shard)]
        number = {node: k for k, node in enumerate(nodes)}
        parts.append([([number[node] for node in shard.nodes.tolist()], shard.beam, [links.tolist() for links in shard.graph.links]) for shard in shards])
    assert len(parts[0]) == 3 and parts[0] == parts[1]


def test_audit_widens_beams(monkeypatch):
    monkeypatch.setattr(vectors, "RECALL", 1.0)
    r = np.random.default_rng(4)
    x = r.normal(size=(800, 16))
    graph = vectors.SmallWorld(x / np.linalg.norm(x, axis=1, keepdims=True))
    beam, recall = vectors.audited_beam(graph, 0.5, beam=1)
    assert recall == 1.0 and beam > 1


def test_audit_leaves_self_matches_out():
    r = np.random.default_rng(5)
    x = r.normal(size=(2000, 16))
    x[1000:1040] = x[:40] + r.normal(size=(40, 16)) * 0.05  # few links
    graph = vectors.SmallWorld(x / np.linalg.norm(x, axis=1, keepdims=True))
    graph.above = lambda queries, threshold, beam: [np.flatnonzero(graph.x @ q >= (threshold if beam >= 2000 else 0.99999)) for q in queries]
    beam, recall = vectors.audited_beam(graph, 0.9)
    assert beam >= 2000 and recall == 1.0


def test_vectors_of_each_dimension_are_linked(spark):
    rows = [(i, [1.0, 0.1 * i, 0.0]) for i in range(3)] + [(10, [1.0, 2.0]), (11, [1.0, 2.1]), (12, [-1.0, 2.0])]
    got = {g.vec_id: (g.n_links, g.component_id) for g in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.95).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 10: (1, 10), 11: (1, 10), 12: (0, 12)}


def test_every_operator_is_registered():
    names = queries.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == []
    assert set(queries.oracle_sql()) <= set(names)
