"""Routing of tasks to experts and tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.numbers import let, softmax, spread_penalty
from lodestone.functions.text import tokens

# fixed values: the experts' domains, the words each answers to, and the weight of a task's mode
EXPERTS = {
    "code_generation": ("function", "class", "module", "api"),
    "code_review": ("security", "performance", "style", "correctness"),
    "refactoring": ("extract", "inline", "move", "rename"),
    "architecture": ("pattern", "scalability", "coupling", "layering"),
    "security": ("auth", "encryption", "validation", "compliance"),
    "performance": ("optimization", "caching", "profiling", "scaling"),
    "testing": ("unit", "integration", "e2e", "property"),
    "documentation": ("api", "readme", "comment", "diagram"),
    "business_logic": ("workflow", "rule", "calculation", "state"),
    "api_design": ("rest", "graphql", "grpc", "schema"),
    "database": ("query", "index", "migration", "schema"),
    "devops": ("ci", "cd", "deploy", "monitor"),
}
MODES = {"convergent": 1.0, "divergent": 0.8, "lateral": 1.2, "systems": 1.5, "critical": 1.3}


def experts(spark: SparkSession, n: int = len(EXPERTS), capacity: int = 100) -> DataFrame:
    """(expert_id, ord, domain, words, capacity): ``n`` experts, domains in turn."""
    domains = list(EXPERTS)
    rows = [(f"expert-{i}", i, domains[i % len(domains)], list(EXPERTS[domains[i % len(domains)]]), capacity) for i in range(n)]
    return spark.createDataFrame(rows, "expert_id string, ord int, domain string, words array<string>, capacity int")


def expert_scores(description: Column, mode: Column, loads: dict[int, float] | None = None, reward: float = 0.8) -> Column:
    """Scores of the twelve experts: 2 per word that the task has, by mode, load (of capacity 100) and reward."""
    factor = F.coalesce(*[F.when(mode == k, F.lit(v)) for k, v in MODES.items()], F.lit(1.0))
    hits = lambda words, spec: sum((F.when(F.array_contains(words, w), 2.0).otherwise(0.0) for w in spec), F.lit(0.0))
    each = lambda words: F.array(*[hits(words, spec) * factor * (1 - (loads or {}).get(i, 0.0) / 100 * 0.5) * reward for i, spec in enumerate(EXPERTS.values())])
    return let(F.array_distinct(tokens(F.coalesce(description, F.lit("")))), each)


def best_expert(scores: Column) -> Column:
    """struct(expert, confidence) of the greatest score, of equal ones the first; confidence by softmax."""
    first = lambda s: F.concat(F.lit("expert-"), (F.array_position(s, F.array_max(s)) - 1).cast("string"))
    return let(scores, lambda s: F.struct(first(s).alias("expert"), F.array_max(softmax(s)).alias("confidence")))


def spectral_expert(scores: Column, lam: float = 0.1) -> Column:
    return best_expert(spread_penalty(scores, lam))


def complexity(description: Column, n_constraints: Column, n_criteria: Column, code: Column) -> Column:
    part = lambda x, most: F.least(x, F.lit(most))
    return F.least(
        F.lit(1.0),
        part(F.coalesce(F.length(description), F.lit(0)) / 1000.0, 0.3) + part(n_constraints * 0.1, 0.3) + part(n_criteria * 0.1, 0.2) + part(F.coalesce(F.length(code), F.lit(0)) / 5000.0, 0.2),
    )


def adaptive_top(scores: Column, width: Column) -> Column:
    """The ``ceil(width * n)`` best experts (1 at least) with the share of the best among them; null share where all are 0."""
    def pick(s: Column) -> Column:
        k = F.greatest(F.lit(1), F.least(F.size(s), F.ceil(width * F.size(s)).cast("int")))
        order = F.sort_array(F.transform(s, lambda x, i: F.struct(x.alias("score"), (-i).alias("neg"))), asc=False)
        total = lambda top: F.aggregate(top, F.lit(0.0), lambda a, t: a + t["score"])
        names = lambda top: F.transform(top, lambda t: F.concat(F.lit("expert-"), (-t["neg"]).cast("string")))
        return let(F.slice(order, 1, k), lambda top: F.struct(names(top).alias("experts"), F.try_divide(top[0]["score"], F.nullif(total(top), F.lit(0.0))).alias("confidence")))

    return let(scores, pick)


def expert_stats(all_experts: DataFrame, routed: DataFrame) -> DataFrame:
    """(expert_id, n, usage, confidence) of every expert, also of unused ones. ``routed``: expert_id, confidence."""
    used = routed.groupBy("expert_id").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))
    joined = all_experts.select("expert_id", "ord").join(used, "expert_id", "left").fillna(0, ["n"]).fillna(0.0, ["confidence"])
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row per expert
    return joined.select("expert_id", "n", F.coalesce(F.try_divide(F.col("n").cast("double"), total), F.lit(0.0)).alias("usage"), "confidence")


def collapsed(stats: DataFrame, n_experts: int) -> DataFrame:
    """Experts used less than a tenth of their fair share."""
    return stats.where(F.col("usage") < 0.1 / n_experts)


def recovered(stats: DataFrame, n_experts: int) -> DataFrame:
    """Experts with ``reset``, whether they had collapsed, and the ``load`` they go on with: none after a reset, else their ``n``."""
    reset = F.col("usage") < 0.1 / n_experts
    return stats.withColumns({"reset": reset, "load": F.when(reset, 0).otherwise(F.col("n"))})


def loads(experts: DataFrame) -> DataFrame:
    """(expert_id, load, rebalanced, target): a load less one, and a load less a tenth of the mean; neither below 0."""
    mean = F.avg("load").over(Window.partitionBy(F.lit(1)))  # one row per expert
    return experts.select("expert_id", "load", F.greatest(F.lit(0), F.col("load") - 1).alias("rebalanced"), F.greatest(F.lit(0.0), F.col("load") - 0.1 * mean).alias("target"))


def rank_tools(tasks: DataFrame, tools: DataFrame) -> DataFrame:
    """Best tool of each task (task_id, text): 1 per hit of a task word in the tool's words, half of 4 less its tier, 1 if not
    destructive; of equal ones the first by ``ord``. ``tools`` is a catalogue: tool, ord, words, tier, destructive."""
    words = tokens(F.coalesce("text", F.lit("")))
    pairs = tasks.join(F.broadcast(tools))  # a fixed catalogue of a few tools
    hits = F.size(F.filter(words, lambda w: F.array_contains(F.col("words"), w)))
    score = hits + (4 - F.col("tier")) * 0.5 + F.when(F.col("destructive"), 0.0).otherwise(1.0)
    best = F.max_by(F.struct("tool", F.lit(0).alias("x")), F.struct(F.lit(0).alias("y"), score.alias("s"), (-F.col("ord")).alias("o")))
    return pairs.groupBy("task_id").agg(best["tool"].alias("tool"), F.max(score).alias("score"))


def tool_for(required: Column, tools: list[tuple[str, list[str]]]) -> Column:
    """The first tool with all required capabilities, else the first."""
    fits = [F.when(F.size(F.array_except(required, F.array(*map(F.lit, caps)))) == 0, F.lit(name)) for name, caps in tools]
    return F.coalesce(*fits, F.lit(tools[0][0]))


def fallbacks(tool: Column, tools: list[str], n: int = 3) -> Column:
    return F.slice(F.filter(F.array(*map(F.lit, tools)), lambda t: t != tool), 1, n)


def weigh(candidates: DataFrame, key: str, criteria: dict[str, tuple[float, float]], least: float) -> DataFrame:
    """(key, score, passed): the weighted mean of columns named by ``criteria`` (weight, least value), passed if all reach theirs and the mean ``least``."""
    total = sum(w for w, _ in criteria.values())
    score = sum((F.col(c) * w for c, (w, _) in criteria.items()), F.lit(0.0)) / total
    met = [F.col(c) >= at for c, (_, at) in criteria.items()] + [F.col("score") >= least]
    out = candidates.withColumn("score", score)
    every = met[0]
    for m in met[1:]:
        every = every & m
    return out.select(key, "score", every.alias("passed"))
