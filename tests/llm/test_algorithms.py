import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import neighbours as p3
from lodestone.llm import percentiles as p2
from lodestone.llm import spans as p1
from lodestone.llm.queries import QUERIES
from lodestone.plans.shared import ship


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


# -- shared spans ------------------------------------------------------------------------------------


def brute_spans(texts: dict[int, str], run: int) -> set:
    held: dict[str, set] = {}
    for r, t in texts.items():
        for i in range(len(t or "") - run + 1):
            held.setdefault(t[i : i + run], set()).add(r)
    out = set()
    for r, t in texts.items():
        at = [i for i in range(len(t or "") - run + 1) if len(held[t[i : i + run]]) > 1]
        while at:
            a = b = at[0]
            while at and at[0] <= b + run:
                b = at.pop(0)
            out.add((r, a, b + run))
    return out


def spans_of(spark, texts, run):
    df = spark.createDataFrame(list(texts.items()), "rid bigint, text string")
    return {(r.rid, r.span_start, r.span_end) for r in p1.stretches(df, run).collect()}


def test_spans_against_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefg é😀\n.") for _ in range(60))
    pool = ["".join(word() for _ in range(r.randint(4, 9))) for _ in range(6)]
    texts = {}
    for i in range(40):
        p = r.choice(pool)
        a = r.randint(0, len(p) // 2)
        texts[i] = word() + p[a : a + r.randint(150, 400)] + word() * r.randint(0, 2)
    texts |= {100: None, 101: "", 102: "x" * 5000, 103: "x" * 700, 104: pool[0], 105: pool[0]}
    assert spans_of(spark, texts, 200) == brute_spans(texts, 200)


def test_spans_empty_and_alone(spark):
    assert spans_of(spark, {1: "a" * 600}, 200) == set()  # a record's own repeats do not count
    assert p1.stretches(spark.createDataFrame([], "rid bigint, text string")).count() == 0


def test_span_longer_than_a_chunk(spark):
    r = random.Random(1)
    long = "".join(r.choices("abcdefghij klm", k=p1.CHUNK + 5000))
    part = long[p1.CHUNK - 400 : p1.CHUNK + 400]
    assert spans_of(spark, {1: long, 2: part}, 200) == {(1, p1.CHUNK - 400, p1.CHUNK + 400), (2, 0, 800)}


def test_span_shares_and_sentences(spark):
    body = " ".join(f"Sentence number {i} says something of its own here." for i in range(12))
    entries = spark.createDataFrame([("a", body + " Tail one.", 1), ("a", body + " Tail one.", 2), ("b", "Head. " + body, 1), ("c", None, 1), (None, body, 1)], "id string, content string, rec_kind int")
    files = spark.createDataFrame([(7, "short")], "pr_file_id bigint, patch string")
    got = {(r.rec_kind, r.rec_id): (r.shared_chars, r.n_spans) for r in p1.shares(entries, files).collect()}
    assert got[("memory_entry", "a")] == (len(body), 1) or got[("memory_entry", "a")] == (len(body) + 1, 1)
    assert got[("memory_entry", "c")] == (0, 0) and got[("pr_file", "7")] == (0, 0) and len(got) == 4
    runs = p1.sentence_runs(entries, files).collect()
    assert {r.rec_id for r in runs if r["first"]} == {"a"} and {r.rec_id for r in runs if not r["first"]} == {"b"} and all(r.n_records == 2 for r in runs)
    assert len(runs) == 20  # ten runs of three in either record


def test_texts_without_repeats(spark):
    same = "One thing. Two things! Three things?\nFour things. "
    kinds = "id string, content string"
    entries = spark.createDataFrame([("a", "Own start. " + same + "End."), ("b", same + "\n\nTail of b."), ("c", None), ("d", ""), ("e", same[:20])], kinds)
    files = spark.createDataFrame([(7, " " + same)], "pr_file_id bigint, patch string")
    got = {r.rec_id: (r.n_sentences, r.n_removed, r.text) for r in p1.without_repeats(entries, files).collect()}
    assert got == {"a": (6, 0, "Own start. " + same + "End."), "b": (5, 4, "\n\nTail of b."), "d": (0, 0, ""), "e": (2, 0, same[:20]), "7": (4, 4, "")}


def test_hot_spans_are_split(spark):
    """A stretch that all records carry: the join of its occurrences is spread over tasks."""
    set_to = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB"}
    before = {k: spark.conf.get(k) for k in set_to}
    for k, v in set_to.items():
        spark.conf.set(k, v)
    try:
        many = spark.range(40000).select((F.col("id") % 5).alias("h"), F.col("id").alias("rid")).withColumn("h", F.when(F.col("h") < 4, F.lit(1)).otherwise(F.col("rid")))
        occurrences = p1.stage(many.repartition(8), "hot")
        joined = occurrences.join(p1._shared(occurrences, "h"), "h")
        assert joined.count() == 32000 and joined.collect() and "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.integers(1, 12))
def test_sliding_minimum(keys, width):
    x = np.array(keys, np.uint64)
    if len(x) >= width:
        assert p1._least(x, width).tolist() == [min(keys[i : i + width]) for i in range(len(keys) - width + 1)]


# -- percentiles -------------------------------------------------------------------------------------


def nearest_rank(values, p):
    return sorted(values)[max(1, math.ceil(round(p * len(values), 6) / 100)) - 1]


def test_percentiles_against_sorting(spark):
    r = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 7}", float(r.choice([1, 1, 2.5, r.random() * 100])), i) for i in range(3000)] + [(None, 4.0, -1), ("hot", None, -2), ("hot", float("nan"), -3)]
    df = spark.createDataFrame(rows, "g string, v double, id bigint")
    got = {(x.g, x.percent): x.value for x in p2.percentiles(p2.value_counts(df, ["g"], "v", "id"), ["g"], [0.0, 50.0, 90.0, 99.9, 100.0]).collect()}
    for g in {x[0] for x in rows}:
        values = [v for k, v, _ in rows if k == g and v is not None and not math.isnan(v)]
        for p in (0.0, 50.0, 90.0, 99.9, 100.0):
            assert got[(g, p)] == nearest_rank(values, p)


def test_percentiles_combine_and_bound_error(spark):
    rows = [("a", float(i) + 0.5, i % 4) for i in range(1, 2000)]
    df = spark.createDataFrame(rows, "g string, v double, day int")
    whole = p2.percentiles(p2.value_counts(df, ["g"], "v"), ["g"], [50.0, 95.0])
    days = p2.merge_counts([p2.value_counts(df.where(F.col("day") == d), ["g"], "v") for d in range(4)], ["g"])
    assert sorted(whole.collect()) == sorted(p2.percentiles(days, ["g"], [50.0, 95.0]).collect())
    rough = {r.percent: r.value for r in p2.percentiles(p2.value_counts(df, ["g"], "v", rel_error=0.01), ["g"], [50.0, 95.0]).collect()}
    assert p2.value_counts(df, ["g"], "v", rel_error=0.01).count() < 400
    for r in whole.collect():
        assert abs(rough[r.percent] - r.value) <= 0.0101 * r.value


def test_percentiles_ids_minimum_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 1), ("a", 9.0, 2), ("b", 3.0, None), ("b", 3.0, None)], "g string, v double, id bigint")
    counts = p2.value_counts(df, ["g"], "v", "id")
    assert {(r.g, r.value, r.n) for r in counts.collect()} == {("a", 1.0, 1), ("a", 9.0, 1), ("b", 3.0, 2)}
    assert p2.percentiles(counts, ["g"], [50.0], min_count=3).count() == 0
    assert p2.percentiles(counts.limit(0), ["g"], [50.0]).count() == 0


# -- neighbours --------------------------------------------------------------------------------------


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, vector array<float>")


def test_neighbours_recall_and_exactness(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 32))
    x = np.concatenate([base, base[:150] + 0.15 * rng.standard_normal((150, 32))])
    q = base[100:200] * 7 + 0.2 * rng.standard_normal((100, 32))
    entries = frame(spark, [(f"e{i:04}", [float(v) for v in r]) for i, r in enumerate(x)])
    queries = frame(spark, [(f"q{i:04}", [float(v) for v in r]) for i, r in enumerate(q)])
    got = {(r.kind, r.id, r.neighbour): r.similarity for r in p3.neighbours(entries, queries, 32, 5, 0.9, trees=6, width=32).collect()}
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    want = {}
    for kind, a, name in (("entry", x, "e"), ("query", q, "q")):
        sims = unit(a) @ unit(x).T
        if kind == "entry":
            np.fill_diagonal(sims, -2)
        for i, row in enumerate(sims):
            for j in np.argsort(-row)[:5]:
                if row[j] >= 0.9:
                    want[(kind, f"{name}{i:04}", f"e{j:04}")] = row[j]
    assert len(want) > 200 and len(want.keys() & got.keys()) / len(want) >= 0.9
    assert all(abs(got[k] - want[k]) < 0.002 for k in want.keys() & got.keys())
    assert not [k for k in got.keys() - want.keys() if abs(got[k] - 0.9) > 0.002]


def test_neighbours_copies_ties_and_unusable(spark):
    v = [float(i % 5) for i in range(8)]
    copies = [(f"c{i:02}", [2.0**i * a for a in v]) for i in range(9)] + [("c00", v)]
    bad = [("n1", None), ("n2", [1.0] * 8), ("n3", [float("nan")] * 8), ("n4", v[:4]), ("n5", [0.0] * 8), ("n6", [*v[:7], float("inf")]), (None, v)]
    got = p3.neighbours(frame(spark, copies + bad), frame(spark, [("q", v), ("qbad", None)]), 8, 3).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r.rank):
        lists.setdefault((r.kind, r.id), []).append(r.neighbour)
        assert r.similarity > 0.999
    assert lists[("query", "q")] == ["c00", "c01", "c02"] and lists[("entry", "c00")] == ["c01", "c02", "c03"] and lists[("entry", "c08")] == ["c00", "c01", "c02"]
    assert set(lists) == {("query", "q")} | {("entry", f"c{i:02}") for i in range(9)}
    assert p3.neighbours(frame(spark, []), frame(spark, []), 8, 3).count() == 0


def test_neighbours_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(4)
        x = rng.standard_normal((120, 16))
        rows = [(f"e{i:03}", [float(v) for v in r]) for i, r in enumerate(x)]
        few = {(r.id, r.neighbour) for r in p3.neighbours(frame(spark, rows), frame(spark, []), 16, 3, trees=2, width=5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert few == {(r.id, r.neighbour) for r in p3.neighbours(frame(spark, rows), frame(spark, []), 16, 3, trees=2, width=5).collect()}


def test_forest_does_not_depend_on_partitions(spark):
    """Far more vectors than a window holds: the forest's own pairs, without the exact pass, are the same for 3 partitions and 40."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((500, 16))
    x = (base[rng.integers(0, 500, 3000)] + 0.15 * rng.standard_normal((3000, 16))).astype(np.float32)
    entries = frame(spark, [(f"e{i:04}", [float(v) for v in r]) for i, r in enumerate(x)])
    classes, _ = p3._classes(entries, frame(spark, []), 16)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    got = []
    try:
        for n in ("3", "40"):
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", n)
            pairs, state = p3._forest(classes, 16, 5, 0.9, 4, 64, 0.9)
            got.append(({(r.a, r.b, r.similarity) for r in pairs.collect()}, {(r.a, r.sure, r.full) for r in state.collect()}))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got[0] == got[1] and len(got[0][0]) > 5000 and 0 < sum(s for _, s, _ in got[0][1])


def test_trees_follow_the_size():
    assert p3.trees_for(1000, 0.9, 0.9, 2048) == 1 and p3.trees_for(60_000, 0.9, 0.9, 2048) < p3.trees_for(60_000_000, 0.9, 0.9, 2048) < 40
    assert p3._leading(np.array([1, 2**31, 2**32, 2**53 - 1, 2**63, 2**64 - 1, 3], dtype=np.uint64)).tolist() == [63, 32, 31, 11, 0, 0, 62]


def test_nearest_lists_every_vector(spark):
    """Far neighbours, scaled copies and near copies alike: what brute force finds, in its order."""
    rng = np.random.default_rng(5)
    far = rng.standard_normal((150, 32))
    near = rng.standard_normal(32) + 0.01 * rng.standard_normal((60, 32))
    x = np.concatenate([far, near]).astype(np.float32).astype(np.float64)
    q = rng.standard_normal((20, 32)).astype(np.float32).astype(np.float64)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    want = {}
    for kind, a, name in (("entry", x, "e"), ("query", q, "q")):
        sims = unit(a) @ unit(x).T
        if kind == "entry":
            np.fill_diagonal(sims, -2)
        for i, row in enumerate(sims):
            want[(kind, f"{name}{i:03}")] = [f"e{j:03}" for j in np.argsort(-row)[:5]]
    rows = lambda a, name: frame(spark, [(f"{name}{i:03}", [float(v) for v in r]) for i, r in enumerate(a)])
    for block in (40, 32768):
        got = {}
        for r in sorted(p3.nearest(rows(x, "e"), rows(q, "q"), 32, 5, block=block).collect(), key=lambda r: r.rank):
            got.setdefault((r.kind, r.id), []).append(r.neighbour)
        assert got == want


def test_nearest_ties_and_unusable(spark):
    v = [float(i % 5) for i in range(8)]
    rows = [(f"c{i:02}", [2.0**i * a for a in v]) for i in range(9)] + [("c00", v), ("n1", None), ("n2", [1.0] * 8), (None, v)]
    lists = {}
    for r in sorted(p3.nearest(frame(spark, rows), frame(spark, [("q", v)]), 8, 3).collect(), key=lambda r: r.rank):
        lists.setdefault((r.kind, r.id), []).append(r.neighbour)
    assert lists[("query", "q")] == ["c00", "c01", "c02"] and lists[("entry", "c00")] == ["c01", "c02", "c03"]
    assert set(lists) == {("query", "q")} | {("entry", f"c{i:02}") for i in range(9)}
    assert p3.nearest(frame(spark, []), frame(spark, []), 8, 3).count() == 0


def test_listed_is_full(spark, sf):
    entries = spark.read.parquet(f"{sf}/memory_entry.parquet")
    n = QUERIES["p3_neighbours"](spark, sf).groupBy("kind", "id").count()
    ids = entries.where(p3.usable(entries.embedding, p3.DIM) & entries.id.isNotNull()).select("id").distinct().count()
    assert ids > 20 and n.where("kind = 'entry'").count() == ids and n.where("count < 10").count() == 0


def test_found_among_near_copies(spark):
    """A group far larger than a window of the forest, all of it above the similarity asked for."""
    rng = np.random.default_rng(6)
    near = rng.standard_normal(128) + 0.2 * rng.standard_normal((2500, 128))
    x = np.concatenate([near, rng.standard_normal((500, 128))]).astype(np.float32)
    ids = [f"e{i:04}" for i in range(len(x))]
    entries = spark.createDataFrame([(n, [float(v) for v in r]) for n, r in zip(ids, x, strict=True)], "id string, embedding array<float>")
    queries = spark.createDataFrame([], "query_id string, vector array<float>")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -2)
    want = {("entry", *sorted((ids[i], ids[j]))) for i, row in enumerate(sims) for j in np.argsort(-row)[:10] if row[j] >= 0.9}
    got = {tuple(r) for r in p3.found(entries, queries).collect()}
    assert len(want) > 10000 and got == want
