"""Neighbours, near copies, mixing, components and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from lectern.llm import mixing, near_copies, neighbours, pii
from lectern.llm.components import components
from lectern.llm.queries import ORACLES, QUERIES
from tools.compare import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    good, note = compare(spark, connect(SMALL), SMALL, name, ORACLES[name])
    assert good, note


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def by_cosine(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8:
            usable.setdefault(i, []).append(np.array(v, dtype=float) / np.abs(v).max())
    out = {}
    for q in usable:
        if q % 5 == 0:
            score = {}
            for i, vectors in usable.items():
                if i != q:
                    score[i] = max(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) for a in usable[q] for b in vectors)
            out[q] = sorted(score.items(), key=lambda s: (-round(s[1], 12), s[0]))[:k]
    return out


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [rows[5], rows[5]]
    rows += [(2000, None), (2005, []), (2010, [0.0] * 8), (2015, [1.0, None] + [0.0] * 6), (2020, [float("nan")] * 8)]
    rows += [(2025, [float("inf")] + [1.0] * 7), (2030, [1.0] * 7), (None, [1.0] * 8), (2035, [1e-300] * 8), (2040, [1e300] * 8)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, list int")
    found = {}
    for r in neighbours.nearest(frame, F.col("id") % 5 == 0, list_size=32, shard=64, query_block=16).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    expected = by_cosine(rows, 5)
    assert set(found) == set(expected)
    for q, near in found.items():
        exact = dict(expected[q])
        assert all(abs(score - exact[i]) < 1e-12 for i, score in near if i in exact)
        assert [n[0] for n in near] == [i for i, _ in sorted(near, key=lambda n: (-n[1], n[0]))]
    hits = [len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) / 5 for q in expected]
    assert np.mean(hits) >= 0.9


def test_neighbours_of_few_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], schema), F.col("id") % 5 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], schema)
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest(two, F.col("id") % 5 == 0).collect()] == [(0, 1)]


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(4)
    index = neighbours.build_index(rng.standard_normal((4000, 16)), 250)
    assert len(index.centroids) == 250
    asked = neighbours.unit(rng.standard_normal((100, 16)))
    nodes, _ = neighbours.search_graph(index, asked, 32)
    exact = np.argsort(-(asked @ index.centroids.T), axis=1)[:, :5]
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) / 5 for a, b in zip(nodes, exact, strict=True)]) > 0.97


def links_by_sets(docs):
    sets = []
    for i, t in docs:
        w = (t or "").lower().split()
        grams = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        sets.append((i, grams))
    parent = {i: i for i, _ in docs if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = [0] * len(sets)
    for a in range(len(sets)):
        for b in range(len(sets)):
            (i, x), (j, y) = sets[a], sets[b]
            if a != b and x and i is not None and j is not None and len(x & y) >= 0.8 * len(x | y):
                n[a] += 1
                ra, rb = find(i), find(j)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted((i, find(i), n[k]) for k, (i, _) in enumerate(docs) if i is not None)


def test_near_copies_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    docs = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 60, 80]))]
        for _ in range(rng.choice([1, 2, 9, 14])):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = word()
            docs.append((len(docs) * 3, " ".join(copy).upper() if g % 2 else " ".join(copy)))
    docs += [(900, docs[0][1]), (901, docs[0][1]), (902, None), (903, ""), (904, " \n"), (None, docs[0][1]), (905, "w " * 3000)]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, text string, node int")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_copies.near_copies(frame).collect())
    assert got == links_by_sets(docs)
    assert near_copies.near_copies(frame.where("false")).count() == 0


def test_texts_that_share_an_id_are_told_apart(spark):
    rng = random.Random(8)
    one, two = (" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(2))
    near = lambda t: t + " end"
    docs = [(5, one), (5, two), (6, near(one)), (7, near(two)), (7, near(two).upper())] + [(5, one)] * 40 + [(4, near(near(two)))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    expected = sorted(
        [(5, 5, 41)] * 41 + [(5, 4, 3), (6, 5, 41), (7, 4, 3), (7, 4, 3), (4, 4, 3)]
    )
    for _ in range(2):
        got = near_copies.near_copies(frame).collect()
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == expected


def test_matched_prefix_meets_the_target():
    depth = near_copies.matched_depth(0.8, 24, 8, 0.99999)
    assert 1 - (1 - 0.8**depth) ** 24 >= 0.99999 > 1 - (1 - 0.8 ** (depth + 1)) ** 24


def test_components_of_chains_and_cycles(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    rng.shuffle(edges)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {n: r for n, r in found.items() if n != r} == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_few_edges_take_few_tasks(spark):
    rng = random.Random(3)
    edges = [(a, rng.randrange(max(1, a - 40), a)) for a in range(2, 400) if a % 50 != 1]
    root = {}
    for a, b in edges:
        root[a] = root.get(b, b)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(30))
        assert found.rdd.getNumPartitions() == 1
        assert {r.node: r.root for r in found.collect()} == root
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_components_are_the_same_in_many_tasks(spark, monkeypatch):
    edges = spark.createDataFrame([(a, a + 1) for a in range(1, 60)] + [(100, a) for a in range(101, 130)], "a bigint, b bigint")
    few = sorted(map(tuple, components(edges).collect()))
    monkeypatch.setattr("lectern.llm.components.few_tasks", lambda df, rows: df)
    assert sorted(map(tuple, components(edges).collect())) == few
    assert few == sorted([(a, 1) for a in range(2, 61)] + [(a, 100) for a in range(101, 130)])


def test_texts_are_not_dealt_out_to_drop_few_documents(spark):
    docs = corpus_pipeline.table(spark, SMALL, "documents")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs.unionByName(docs.limit(20)), SMALL)
    assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    clean = corpus_pipeline.drop_benchmark_leaks(spark, docs, SMALL)
    assert "SortMergeJoin" not in clean._jdf.queryExecution().executedPlan().toString()


def test_mix_of_odd_rows(spark):
    rows = [(i, "w " * 10, "big") for i in range(90)] + [(100 + i, "w " * 10, "tiny") for i in range(3)]
    rows += [(200, None, None), (201, "", "none"), (None, "w w", "tiny"), (0, "w " * 10, "big")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, block int")
    found = mixing.mix_sources(docs, entropy_share=1.0, repeat_limit=3.0).collect()
    taken = {}
    for r in found:
        taken[r.source] = taken.get(r.source, 0) + r.tokens
        assert r.start_token + r.tokens <= r.source_tokens
    budgets = {r.source: r.source_tokens for r in found}
    assert taken["tiny"] <= 3.0 * 32 + 1 and budgets["tiny"] > 2.9 * 32
    assert budgets["big"] - 10 < taken["big"] <= budgets["big"]
    assert sum(r.doc_id == 201 for r in found) == 1
    assert mixing.mix_sources(docs.where("false")).count() == 0
    single = mixing.mix_sources(docs.where("source = 'big'")).collect()
    assert len(single) == 91 and {r.epoch for r in single} == {0}
    epochs = {}
    for r in found:
        if r.source == "tiny":
            epochs.setdefault(r.epoch, []).append(r.doc_id)
    assert all(len(v) == 4 for e, v in epochs.items() if e < max(epochs))


def test_pipeline_keeps_clean_documents_and_acts(spark, tmp_path):
    rng = random.Random(7)
    pool = {"en": "the and of to with from that have this will which there", "fr": "les des une dans pour avec elle nous vous leur sont était"}
    say = lambda lang, n: " ".join(rng.choice(pool[lang].split()) + rng.choice("aeiou") * rng.randint(0, 3) for _ in range(n))
    item = say("en", 30)
    clean = [(i, say("en" if i % 2 else "fr", 60), "en" if i % 2 else "fr", f"s{i % 3}", 1) for i in range(60)]
    rows = [*clean, (70, clean[3][1], "en", "s0", 1), (71, clean[4][1] + " fin", "fr", "s0", 1)]
    rows += [(80, say("en", 20) + " " + item + " " + say("en", 20), "en", "s1", 1), (90, "0 1 !", "en", "s1", 5), (91, None, "fr", None, None)]
    rows += [(92, say("en", 40) + " write to a.b@mail.org", "en", "s2", 9), (None, say("fr", 50), "fr", "s2", 3), (5, clean[5][1], "en", "s2", 1)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, score int")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        ids.append(sorted(str(r.doc_id) for r in docs.select("doc_id").collect()))
        if name != "mix":
            assert docs.dtypes == before.dtypes
    known = {str(r[0]) for r in rows}
    assert known - set(ids[0]) == {"90", "91"}
    assert set(ids[0]) - set(ids[1]) == {"70", "71"} and ids[1].count("5") == 1
    assert set(ids[1]) - set(ids[2]) == {"80"} and ids[2] == ids[3]
    masked = spark.read.parquet(f"{folder}/personal_data").where("doc_id = 92").first()
    assert masked.text.endswith("write to <EMAIL>") and masked.n_chars == len(masked.text)
    untouched = {r.doc_id: (r.text, r.n_chars) for r in spark.read.parquet(f"{folder}/personal_data").collect()}
    assert all(untouched[i] == (t, n) for i, t, _, _, n in clean)
    assert set(ids[4]) <= set(ids[3]) and {"mix_epoch", "mix_start_token"} <= set(docs.columns)


def test_pipeline_over_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert pii.find_pii(docs).count() == 0


def test_pipeline_rows_that_share_an_id_stay_apart(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    one, two, three, four = (say(60) for _ in range(4))
    rows = [(1, one), (2, one + " fin"), (2, two), (3, three), (3, four), (4, two + " end"), (4, "own words"), (4, "own words"), (5, ""), (6, "")]
    docs = spark.createDataFrame([(i, t, "s", len(t)) for i, t in rows], "doc_id bigint, text string, source string, n_chars bigint")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    expected = [(1, one), (2, two), (3, three), (3, four), (4, "own words"), (5, ""), (6, "")]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(expected)
    twice = docs.where("doc_id in (3, 4)").union(docs.where("doc_id = 3"))
    mixed = corpus_pipeline.mix_to_weights(spark, twice, "").where("mix_epoch = 0").collect()
    assert sorted((r.doc_id, r.text) for r in mixed) == sorted((r.doc_id, r.text) for r in twice.collect())
