import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.catalog import QUERIES
from lodestone.operators import folds, graph, quality, search
from lodestone.operators.ranking import index_within
from lodestone.plans.shared import drop_staged, ship, stage
from lodestone.sources import store


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vector array<float>")


@pytest.mark.parametrize("space", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("limit", [64 << 20, 200])
def test_knn_against_brute_force(spark, space, limit):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (60, 4)).astype(float)
    x[(x == 0).all(1)] = 1
    rows = [(i, [float(z) for z in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 4), (902, [float("nan")] * 4), (903, [1.0]), (None, [1.0] * 4)]
    queries = vectors(spark, rows[:20] + rows[60:])
    got = {}
    for r in search.knn(queries, vectors(spark, rows), 4, 7, space, limit).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.id
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(20):
        d = {"cosine": 1 - unit @ unit[q], "l2": ((x - x[q]) ** 2).sum(1), "ip": 1 - x @ x[q]}[space]
        assert [got[q][k] for k in range(1, 8)] == [i for _, i in sorted((round(float(z), 9), i) for i, z in enumerate(d))[:7]]
    assert set(got) == set(range(20)) and search.knn(queries.limit(0), vectors(spark, rows), 4, 7).count() == 0


def test_hybrid_and_mmr(spark):
    entries = spark.createDataFrame([(1, [1.0, 0.0], "saga saga", 1.0), (2, [1.0, 0.1], None, None), (3, [0.0, 1.0], "saga", 0.5), (4, None, "saga", 1.0)], "id bigint, vector array<float>, content string, reward double")
    queries = spark.createDataFrame([(7, [1.0, 0.0], "Saga", 3), (8, [0.0, 1.0], None, None), (9, None, "x", 1)], "id bigint, vector array<float>, text string, k int")
    ranked = search.hybrid_search(queries, entries, 2)
    got = {(r.qid, r.id): r for r in ranked.collect()}
    assert {k for k in got} == {(7, 1), (7, 2), (7, 3), (8, 1), (8, 2), (8, 3)}
    assert got[7, 1]["rank"] == 1 and got[8, 1].text_score is None and abs(got[8, 3].score - 0.75) < 1e-9 and got[7, 2].text_score == 0
    chosen = {(r.qid, r.mmr_rank): r.id for r in search.mmr(ranked, entries.select("id", "vector")).collect()}
    assert chosen[7, 1] == 1 and chosen[7, 2] == 3 and sorted(chosen[8, i] for i in (1, 2, 3)) == [1, 2, 3]  # a permutation


def test_index_percentiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", 1.0), ("b", None), ("c", None)], "g string, v double")
    got = {r.g: (r.n, r.p50, r.p99, r.p100) for r in search.index_percentiles(df, "g", "v", {"p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()}
    assert got == {"a": (100, 50.0, 99.0, 99.0), "b": (1, 1.0, 1.0, 1.0)}


def test_index_within_hot_and_null_groups(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("hot")).alias("k"), "id", F.lit("clash").alias("__n"))
    got = index_within(df, ["k"], F.col("id"), salts=8).collect()
    for k in (None, "hot"):
        idx = sorted(r.idx for r in got if r.k == k)
        assert idx == list(range(len(idx)))
    assert len(got) == 500


def test_store(spark):
    rows = [("a", 1, "x", 5), ("a", 2, None, 6), ("b", None, "y", 7), (None, 1, "z", 8), (None, 1, "z", 9)]
    df = spark.createDataFrame(rows, "id string, at int, v string, w int")
    kept = {(r.id, r.v, r.w) for r in store.latest(df, ["id"], ["at", "w"]).collect()}
    assert kept == {("a", None, 6), ("b", "y", 7), (None, "z", 9)}
    base = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], "id string, v string, w int")
    changes = spark.createDataFrame([("b", None, 9), ("c", "3", 3)], "id string, v string, w int")
    assert {tuple(r) for r in store.update(base, changes, "id").collect()} == {("a", "1", 1), ("b", "2", 9)}
    assert {tuple(r) for r in store.upsert(base, changes, "id").collect()} == {("a", "1", 1), ("b", None, 9), ("c", "3", 3)}
    assert {r.id for r in store.delete(base, changes, "id").collect()} == {"a"} and {r.id for r in store.by_ids(base, changes, "id").collect()} == {"b"}
    records = store.as_records(base, "p:", "id")
    assert {tuple(r) for r in store.from_records(records, "p:", base.schema).collect()} == {tuple(r) for r in base.collect()}


def test_files_and_staging(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert [r.content for r in store.read_files(spark, str(tmp_path)).collect()] == ["one\ntwo"]
    t = stage(spark.range(10), "t")
    assert t.count() == 10 and stage(t.limit(0), "e").count() == 0
    drop_staged(t)


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src int, dst int")


def test_graph(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (4, 3), (4, 5), (6, 6), (1, 2)])
    reach = {(r.src, r.dst): r.depth for r in graph.closure(e).collect()}
    assert reach == {(1, 2): 1, (1, 3): 1, (1, 4): 2, (1, 5): 3, (2, 3): 1, (2, 4): 2, (2, 5): 3, (3, 3): 2, (3, 4): 1, (3, 5): 2, (4, 3): 1, (4, 4): 2, (4, 5): 1, (6, 6): 1}
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node int")
    assert {r.node: r.layer for r in graph.layers(nodes, e).collect()} == {1: 0, 2: 1, 3: -1, 4: -1, 5: -1, 6: -1, 7: 0}
    assert {tuple(r.cycle) for r in graph.short_cycles(edges(spark, [(1, 2), (2, 1), (2, 3), (3, 1), (5, 4), (4, 5)])).collect()} == {(1, 2), (1, 2, 3), (4, 5)}
    assert graph.closure(edges(spark, [])).count() == 0 and graph.degree_coupling(edges(spark, []), nodes.limit(0)).first().coupling == 0


def test_imports(spark):
    rows = [("r", "src/a/x.ts", [("./y",), ("../b/z",), ("fs",), ("./none",)]), ("r", "src/a/y.ts", None), ("r", "src/a/y.js", []), ("r", "src/b/z/index.ts", [("../../a/x",), ("../../../src/a/x",)]), ("q", "src/a/y.ts", [("./x",)])]
    files = spark.createDataFrame(rows, "repo string, file string, imports array<struct<source:string>>")
    assert {(r.src, r.dst) for r in graph.import_edges(files).collect()} == {("src/a/x.ts", "src/a/y.js"), ("src/a/x.ts", "src/b/z/index.ts"), ("src/b/z/index.ts", "src/a/x.ts")}


def test_ema_goldens_and_ranges(spark):
    good = [("good", i, True, 500.0, 2, 0.9) for i in range(5)]
    bad = [("bad", i, False, 5000.0, 10, 0.2) for i in range(5)]
    df = spark.createDataFrame(good + bad + [(None, 0, True, None, None, 0.0)], "k string, seq int, ok boolean, ms double, calls int, c double")
    scored = df.withColumn("s", folds.score_four(F.col("ok"), F.col("ms"), F.col("calls"), F.col("c")))
    final = {r.k: round(r.ema, 8) for r in folds.ema(scored, "k", ["seq"], "s").collect()}
    assert final["good"] == 0.88130125 and final["bad"] == 0.3530257 and None in final
    steps = {(r.k, r.seq): round(r.ema, 8) for r in folds.ema_history(scored.where("k IS NOT NULL"), "k", ["seq"], "s").collect()}
    assert [steps["good", i] for i in range(5)] == [0.6375, 0.73375, 0.801125, 0.8482875, 0.88130125] and steps["bad", 4] == 0.3530257
    r = random.Random(4)
    rows = [("hot" if i % 4 else f"k{i % 9}", i, r.random()) for i in range(4000)]
    want = {}
    for k, _, v in rows:
        want[k] = 0.3 * v + 0.7 * want.get(k, 0.5)
    got = {x.k: x.ema for x in folds.ema(spark.createDataFrame(rows, "k string, seq int, v double"), "k", ["seq"], "v").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_ttl_lru_votes_alerts(spark):
    t0 = datetime(2025, 1, 1, 23, 50)
    rows = [("a", t0 + timedelta(minutes=m)) for m in (0, 5, 30, 31)] + [("b", t0), (None, t0), (None, t0 + timedelta(minutes=1))]
    hits = folds.ttl_hits(spark.createDataFrame(rows, "k string, at timestamp_ntz"), "k", "at", 600).collect()
    assert [r.hit for r in sorted((h for h in hits if h.k == "a"), key=lambda h: h.at)] == [False, True, False, True] and sum(h.hit for h in hits) == 3 and len(hits) == 7
    ops = spark.createDataFrame([(1, "set", "a"), (2, "set", "b"), (3, "get", "a"), (4, "set", "c"), (5, "set", "a"), (6, "set", "d")], "seq int, op string, k string")
    assert folds.lru(ops, "seq", "op", "k", 2) == ["c", "d"]
    votes = spark.createDataFrame([("p", "x", 1, True), ("p", "x", 2, False), ("p", "y", 1, False), ("p", "z", 1, None)], "p string, v string, at int, yes boolean")
    assert tuple(folds.majority(votes, "p", "v", ["at"], "yes", 3).first()) == ("p", 0, 2, False, True)
    samples = spark.createDataFrame([("m", i, b) for i, b in enumerate([1, 9, 9, 1, 9])] + [("m", 5, None)], "m string, at int, v int")
    assert [tuple(r) for r in folds.alert_episodes(samples, "m", "at", F.col("v") > 5).orderBy("opened").collect()] == [("m", 1, 2, 2, True), ("m", 4, 4, 1, True)]


FILES = "repo string, file string, language string, imports array<struct<source:string>>, classes array<struct<name:string,n_methods:int,n_properties:int,line:int,complexity:int>>, n_functions int, metrics struct<lines_of_code:int,cyclomatic_complexity:int,cognitive_complexity:int,nesting_depth:int,maintainability_index:double>"


def test_quality(spark):
    rows = [("r", "god.ts", "typescript", [], [("G", 25, 20, 3, 10)], 5, (100, 10, 12, 2, 50.0)), ("r", "ok.go", " Go ", None, None, None, (50, 5, 6, 2, 80.0)), ("r", "none.ts", None, None, [], 20, None), ("r", "bad.py", "python", [("asyncio",)], [("B", 1, 1, 9, 16)], 3, (900, 30, 40, 9, 20.0))]
    files = spark.createDataFrame(rows, FILES)
    got = {r.file: r for r in quality.file_scores(files).collect()}
    assert got["god.ts"].scalability == 75 and got["god.ts"].maintainability == 92.5 and got["ok.go"].scalability == 100 and (got["none.ts"].maintainability, got["none.ts"].scalability, got["none.ts"].performance) == (100, 90, 90)
    assert got["bad.py"].maintainability == 100 - 30 - 25 - 15 - 22.5 and got["bad.py"].scalability == 100
    found = sorted((r.rule, r.subject or "") for r in quality.issues(files).collect() if r.file == "god.ts")
    assert found == [("AP-FEATURE_ENVY", ""), ("AP-GOD_CLASS", ""), ("AP-GOD_CLASS", "G"), ("AP-GOD_CLASS", "G"), ("AP001", "G")]
    assert {r.rule for r in quality.issues(files).where("file = 'bad.py'").collect()} == {"AP-GOD_CLASS", "AP-GOD_METHOD", "AP-FEATURE_ENVY", "CC001"}
    worst = {r.file: r.dimension for r in quality.recommendations(quality.file_scores(files), quality.issues(files)).collect()}
    assert worst == {"bad.py": "maintainability"} and quality.issues(files.limit(0)).count() == 0


def test_similar_titles_of_any_branch_and_first_word(spark, tmp_path):
    titles = ["fix the slow cache", "repair the slow cache", "the slow cache of queues", "Cache slow", "other words", None, "the slow cache fix now please", "a b", "b a"]
    rows = [(i, title, f"branch{i}") for i, title in enumerate(titles)]
    spark.createDataFrame(rows, "pr_id bigint, title string, base_branch string").write.parquet(f"{tmp_path}/pull_request.parquet")
    words = {i: set(title.lower().split()) for i, title, _ in rows if title}
    want = set()
    for i, a in words.items():
        near = sorted((-round(len(a & b) / max(len(a), len(b)), 6), j) for j, b in words.items() if i != j and 2 * len(a & b) > max(len(a), len(b)))
        want |= {(i, j, -o) for o, j in near[:5]}
    got = {tuple(r) for r in QUERIES["rnk_pattern_similar"](spark, str(tmp_path)).select("pr_id", "other", "overlap").collect()}
    assert len(want) > 6 and got == want


def test_parameters_are_whole_embeddings(spark, sf):
    row = spark.read.parquet(f"{sf}/memory_entry.parquet").where("size(embedding) = 128 AND forall(embedding, x -> abs(x) < 1e30) AND reward IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), F.first("embedding").alias("e")).where("n = 1").first()
    e = np.array(row.e, dtype=float)
    one = lambda name: QUERIES[name](spark, sf).where((F.col("key") if name == "num_ewc_loss" else F.col("id")) == row.id).first()
    assert len(one("num_gradients").g) == len(one("num_fisher").f) == len(one("st_fisher_ema").f) == 128
    assert one("num_ewc_loss").loss == pytest.approx(5 * np.sum(e**2 * (e / 2) ** 2), abs=2e-6)
    assert one("num_flatten").v == [*row.e, *row.e[:2]]


def test_circular_dependencies_of_any_length(spark, sf):
    after = {i: (2 * i + 1) % 25 for i in range(25)}
    want = set()
    for i in after:
        j = after[i]
        for _ in range(25):
            if j == i and after[i] != i:
                want.add(i)
            j = after[j]
    assert len(want) == 24 and {r.node for r in QUERIES["ap_circular_dependency"](spark, sf).collect()} == want


def test_closure_has_no_limit_of_its_own(spark):
    """A chain of more than 64 edges takes minutes here, so a short one and the defaults stand for it."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(4)], "src int, dst int")
    assert graph.closure(chain).count() == 10 and graph.closure(chain, 2).count() == 7
    assert graph.closure.__defaults__ == (None,) and graph.on_cycles.__defaults__ == (None,)
