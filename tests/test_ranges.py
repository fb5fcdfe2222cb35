"""Operators that work in ranges of a sorted table, the replay of eligibility, rules on texts, the inverted file."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as x
from lodestone.operators import ann, catalogue, extract, folds, graph, learning, quality, ranking, routing, search
from lodestone.plans.shared import ship
from lodestone.sources import store


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def test_running_sums_and_places(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), i, r.choice([None, 1, 2, 5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, v int").withColumn("n", F.lit("clash"))
    got = {x.i: x.n for x in ranking.running_sums(df, ["k"], ["i"], {"n": F.col("v")}).collect()}
    want, sums = {}, {}
    for k, i, v in rows:
        if v is not None:
            sums[k] = sums.get(k, 0) + v
        want[i] = sums.get(k)
    assert got == want
    whole = {x.i: x.s for x in ranking.running_sums(df, [], ["i"], {"s": F.lit(1)}).collect()}
    assert whole == {i: i + 1 for i in range(3000)}
    places = ranking.in_order(df.select("k", "i"), [F.desc("i")], "k").collect()
    assert all(p.k == 2999 - p.i for p in places)
    assert ranking.running_sums(df.limit(0), ["k"], ["i"], {"n": F.col("v")}).count() == 0 and ranking.in_order(df.limit(0), ["i"]).count() == 0


def test_moving_average_after_each_event(spark):
    r = random.Random(6)
    rows = [(r.choice(["hot", "hot", None, "b"]), i, r.choice([None, r.random()])) for i in range(2500)]
    got = {e.i: (e.ema, e.n) for e in folds.ema_history(spark.createDataFrame(rows, "k string, i int, v double"), "k", ["i"], "v").collect()}
    state, count = {}, {}
    for k, i, v in rows:
        if v is None:
            assert i not in got
            continue
        state[k], count[k] = 0.3 * v + 0.7 * state.get(k, 0.5), count.get(k, 0) + 1
        assert abs(got[i][0] - state[k]) < 1e-12 and got[i][1] == count[k]


def replay(rows, roles):
    """One event at a time, every agent's state in a table."""
    state, out = {}, []
    for agent, seq, v in rows:
        s = state.setdefault(agent, {"ema": 0.5, "n": 0, "ok": True, "down": 0, "up": 0})
        s["ema"], s["n"] = 0.3 * v + 0.7 * s["ema"], s["n"] + 1
        warm = [a["ema"] for a in state.values() if a["n"] >= 3]
        threshold = 0.6 * sum(warm) / len(warm) if warm else None
        ok = roles.get(agent) in folds.PROTECTED or s["n"] < 3 or s["ema"] >= threshold
        s["down"], s["up"], s["ok"] = s["down"] + (s["ok"] and not ok), s["up"] + (ok and not s["ok"]), ok
        out.append((agent, seq, s["n"], round(s["ema"], 9), threshold and round(threshold, 9), ok, s["down"], s["up"]))
    return out


def test_eligibility_is_that_of_a_replay(spark):
    r = random.Random(8)
    roles = {"a": "worker", "b": "security", "c": None, "d": "tester"}
    rows = [(r.choice("aaaabcde"), i, r.choice([0.0, 0.1, 0.3, 0.9, 1.0]) * (0.2 if r.random() < 0.4 else 1)) for i in range(900)]
    df = spark.createDataFrame([*rows, (None, 1000, 1.0)], "agent string, seq int, v double")
    agents = spark.createDataFrame(list(roles.items()), "agent string, role string")
    got = folds.eligibility(df, agents, "agent", ["seq"], "v").collect()
    mine = sorted((g.agent, g.seq, g.n, round(g.ema, 9), None if g.threshold is None else round(g.threshold, 9), g.eligible, g.suspensions, g.recoveries) for g in got)
    want = sorted(replay(rows, roles))
    assert mine == want and any(w[6] > 1 for w in want) and any(w[7] for w in want)


def test_eligibility_goldens(spark):
    """A good agent's five outcomes, then a bad one's: suspended from its fourth on."""
    score = lambda ok, latency, calls, consensus: folds.score_four(F.lit(ok), F.lit(latency), F.lit(calls), F.lit(consensus))
    rows = spark.range(10).select(F.when(F.col("id") < 5, "good").otherwise("bad").alias("agent"), F.col("id").alias("seq"), F.when(F.col("id") < 5, score(True, 500.0, 2, 0.9)).otherwise(score(False, 5000.0, 10, 0.2)).alias("v"))
    got = folds.eligibility(rows, spark.createDataFrame([("bad", "worker"), ("good", "worker")], "agent string, role string"), "agent", ["seq"], "v").orderBy("seq").collect()
    near = lambda values, want: all(abs(v - w) < 1e-7 for v, w in zip(values, want, strict=True))
    assert near([g.ema for g in got], [0.6375, 0.73375, 0.801125, 0.8482875, 0.88130125, 0.447, 0.4099, 0.38393, 0.365751, 0.3530257])
    assert near([g.threshold for g in got[7:]], [0.3795694, 0.3741157, 0.3702981]) and [g.eligible for g in got[5:]] == [True, True, True, False, False] and got[9].suspensions == 1


def test_suspend_and_recover(spark):
    cols = "agent_id string, role string, ema_score double, sample_count bigint, eligible boolean, suspension_count int, recovery_attempts int"
    rows = [("a", "worker", 0.9, 9, True, 0, 0), ("b", "worker", 0.5, 9, False, 1, 0), ("c", "worker", 0.1, 9, False, 1, 0), ("d", "security", 0.05, 9, False, 1, 0), ("e", None, None, 1, None, 0, 0)]
    agents = spark.createDataFrame(rows, cols)
    down = {r.agent_id: (r.eligible, r.suspension_count) for r in folds.suspend(agents, F.col("ema_score") < 0.6).collect()}
    assert down == {"a": (True, 0), "b": (False, 2), "c": (False, 2), "d": (False, 2), "e": (None, 0)}
    back = {r.agent_id: (r.eligible, r.recovery_attempts, r.ema_score) for r in folds.recover(agents, ~F.col("eligible")).collect()}
    assert back["b"] == (True, 1, 0.6) and back["c"] == (False, 0, 0.2) and back["d"][:2] == (True, 0) and back["a"] == (True, 0, 0.9) and back["e"] == (None, 0, None)


def test_in_flight(spark):
    spans = spark.createDataFrame([(0, 10), (5, 15), (10, None), (None, 3), (12, 13), (12, 14)], "a int, b int")
    got = [(r.at, r.running, r.waits) for r in folds.in_flight(spans, "a", "b", 3).orderBy("at").collect()]
    assert got == [(0, 1, False), (5, 2, False), (10, 2, False), (12, 4, True), (13, 3, False), (14, 2, False), (15, 1, False)]


def test_caches(spark):
    r = random.Random(9)
    rows = [(r.choice([1, 1, 1, 2, None]), i, r.choice(["get", "set", "set"]), r.choice("abcdefgh")) for i in range(500)]
    got = {}
    for e in folds.lru_caches(spark.createDataFrame(rows, "c int, i int, op string, k string"), "c", "i", "op", "k", 3).orderBy("place").collect():
        got.setdefault(e.c, []).append(e.k)
    want = {}
    for c, _, op, k in rows:
        held = want.setdefault(c, [])
        if op == "get" and k in held:
            held.append(held.pop(held.index(k)))
        elif op == "set" and k not in held:
            if len(held) == 3:
                held.pop(0)
            held.append(k)
    assert got == want


@pytest.mark.parametrize("space", ["cosine", "l2", "ip"])
def test_nearest_items_keep_ties_by_id(spark, space):
    rng = np.random.default_rng(3)
    base = rng.integers(-2, 3, (150, 4)).astype(float)
    x_, q = base[rng.integers(0, 150, 900)], base[:30]
    x_[np.abs(x_).sum(1) == 0], q[np.abs(q).sum(1) == 0] = 1.0, 1.0
    items = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x_)] + [(None, [1.0] * 4), (5000, None), (5001, [1.0])], "id int, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, [float(c) for c in v], 1 + i % 12) for i, v in enumerate(q)], "id int, vector array<double>, k int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = {}
        for r in search.knn(queries, items, 4, 9, space).orderBy("rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        few = search.knn(queries, items, 4, 9, space, broadcast_bytes=4000).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for i, v in enumerate(q):
        near = {"cosine": 1 - x_ @ v / np.linalg.norm(x_, axis=1) / np.linalg.norm(v), "l2": ((x_ - v) ** 2).sum(1), "ip": 1 - x_ @ v}[space]
        assert got[i] == sorted(range(900), key=lambda j: (round(near[j], 9) + 0.0, j))[: min(9, 1 + i % 12)]
    assert few == sum(map(len, got.values()))


def test_inverted_file_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    centroids = ann.fit(rows, 64, 32)
    some = rows.where("id % 20 = 0")
    near = {(r.qid, r.id) for r in ann.search(some, ann.index(rows, 64, centroids), 64, 10, centroids, 22).collect()}
    true = {(r.qid, r.id) for r in search.knn(some, rows, 64, 10).collect()}
    assert len(near & true) >= 0.9 * len(true) and len(ann.fit(rows.limit(0), 64, 8)) == 0


def test_rules_on_texts(spark):
    code = "+async function f(a: number, b: string, c: number) {}\n+function g(x: number, y: string, z: number) {}\n+def h(self, k=1):\n+func i()\n"
    row = spark.createDataFrame([(code,)], "c string").select(extract.parameters(F.col("c")).alias("p")).select("p", F.transform("p", extract.signature).alias("s")).collect()[0]
    assert [len(p) for p in row.p] == [3, 3, 2, 0] and row.s == ["number,string,number", "number,string,number", "self,k", ""]
    lines = [f"+line number {i} of a file" for i in range(20)]
    files = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:18])), (3, "\n".join(lines[:3])), (4, "\n".join(f"+other {i}" for i in range(9))), (5, None), (6, "\n".join([*lines[:6], *(f"+mine {i}" for i in range(30))]))], "id int, t string")
    assert {r.id: (r.shingles, r.shared) for r in quality.duplicates(files, "id", "t").collect()} == {1: (15, 13), 2: (13, 13)}
    layered = spark.createDataFrame([("src/OrderController.ts", "new UserRepository()"), ("src/order_service.ts", "Repository"), ("src/service.ts", "HttpRequest r"), (None, "DAO"), ("domain/a.ts", None)], "f string, c string")
    assert [r.b for r in layered.select(quality.breaks_layer(F.col("f"), F.col("c")).alias("b")).collect()] == [True, False, True, False, False]
    unsafe = spark.createDataFrame([("apiKey = 'x'; password: \"p\"; innerHTML = a",), ("query('select ${a} x')",), ("",), (None,)], "c string").select(x.code_findings(F.col("c")).alias("lost"), x.code_issues(F.col("c")).alias("n")).collect()
    assert [(r.lost, r.n) for r in unsafe] == [(75, 3), (20, 1), (0, 0), (0, 0)]


def test_gate_and_dependents(spark):
    requests = spark.createDataFrame([("p",), ("q",), ("r",)], "pr string")
    changes = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "b")], "pr string, f string")
    got = {r.pr: (r.passed, r.files) for r in quality.gate(requests, changes, spark.createDataFrame([("b",), (None,)], "f string"), "pr", "f").collect()}
    assert got == {"p": (False, ["a"]), "q": (True, []), "r": (True, [])}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (4, 1)], "src int, dst int")
    assert {(r.node, r.dependent) for r in graph.dependents(edges).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4) if a != b}


def test_project_delta_and_added_rules(spark):
    metrics = "struct<lines_of_code:int,cyclomatic_complexity:int,cognitive_complexity:int,nesting_depth:int,maintainability_index:double>"
    cols = f"parse_id int, repo string, file string, language string, imports array<struct<source:string>>, classes array<struct<name:string,n_methods:int,n_properties:int,line:int,complexity:int>>, n_functions int, metrics {metrics}, parsed_at int, ingested_at int"
    row = lambda i, f, cc, at: (i, "r", f, "go", [], [], 1, (100, cc, 1, 1, 70.0), at, at)
    parses = spark.createDataFrame([row(1, "a", 5, 1), row(2, "a", 20, 3), row(3, "b", 5, 1), row(4, "c", 5, 3)], cols)
    got = quality.project_delta(parses, F.col("parsed_at") > 2).collect()
    assert [(r.before, r.after, r.delta, r.n_changed) for r in got] == [(100, 98, -2, 2)]
    found = quality.issues(parses.where("parse_id = 2"), {"deep": lambda f: quality.files_where(f, "AP-DEEP", "low", quality.m("nesting_depth") >= 1)}).collect()
    assert {r.rule for r in found} == {"AP-DEEP"} and len(quality.SEVERITIES) == 15


def test_generated_weights_and_importance(spark):
    names = spark.createDataFrame([("security",), ("security",), (None,)], "n string")
    got = {(r.part, r.pos): r.v for r in learning.lora_weights(names, "n").collect()}
    assert len(got) == 64 * 384 * 2 + 384
    for part, shift, n in (("a", 0, 64 * 384), ("b", 1000, 64 * 384), ("scales", 2000, 384)):
        h = 949122880 + shift
        for i in range(n):
            h = (h * 1664525 + 1013904223) & 0xFFFFFFFF
            h -= (h >> 31) << 32
            v = h / 0xFFFFFFFF
            assert abs(got[part, i] - (v * 0.5 + 0.75 if part == "scales" else (v * 2 - 1) * 0.01)) < 1e-15
    assert [round(got["a", i], 8) for i in range(3)] == [-0.00776291, -0.0080579, -0.00555027]
    rows = spark.createDataFrame([("p", 0.8, 3), ("q", -1.05, 3), ("r", 0.2, 5)], "id string, reward double, n int")
    for r in learning.importance_summary(rows, "reward", "n", 50).collect():
        want = [max(0.0, 0.5 * r.reward + 0.5 + 0.1 * np.sin(r.n + i)) for i in range(50)]
        assert abs(r["mean"] - np.mean(want)) < 1e-12 and abs(r["least"] - min(want)) < 1e-12 and abs(r["greatest"] - max(want)) < 1e-12


def test_catalogue_and_weighing(spark):
    assert catalogue.servers(spark).count() == 4 and catalogue.tools(spark).count() == 18
    assert [r.name for r in catalogue.with_capability(catalogue.servers(spark), "payment").collect()] == ["business-payments"]
    rows = spark.createDataFrame([("x", 1.0, 0.924), ("y", 0.5, 1.0)], "k string, a double, b double")
    got = {r.k: (round(r.score, 6), r.passed) for r in routing.weigh(rows, "k", {"a": (0.75, 0.9), "b": (0.25, 0.85)}, 0.85).collect()}
    assert got == {"x": (0.981, True), "y": (0.625, False)}
    stats = spark.createDataFrame([("e0", 99, 0.99, 0.5), ("e1", 1, 0.01, 0.2), ("e2", 0, 0.0, 0.0)], "expert_id string, n long, usage double, confidence double")
    assert {r.expert_id: (r.reset, r.load) for r in routing.recovered(stats, 3).collect()} == {"e0": (False, 99), "e1": (True, 0), "e2": (True, 0)}
    assert store.generated_entries(spark, 5, 8).where("size(vector) = 8 AND exists(vector, v -> v <> 0)").count() == 5
