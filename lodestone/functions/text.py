"""Expressions on texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.numbers import let


def tokens(text: Column) -> Column:
    """Lower-cased, cut at runs of white space; empty tokens at the ends stay."""
    return F.split(F.lower(text), r"\s+", -1)


def bm25(text: Column, terms: Sequence[str] | Column, k1: float = 1.2, b: float = 0.75, average: float = 100.0, idf: float = 0.4054651081081644) -> Column:
    """BM25 of a text against query terms (a repeated term counts again), with a constant idf and average length unless given.

    A null text or an empty query scores 0.
    """
    query = terms if isinstance(terms, Column) else F.array(*[F.lit(t.lower()) for t in terms])

    def total(words: Column) -> Column:
        length = F.size(words)
        part = lambda tf: idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
        counts = F.transform(query, lambda term: F.size(F.filter(words, lambda w: w == term)).cast("double"))
        return F.aggregate(F.transform(counts, part), F.lit(0.0), lambda s, x: s + x)

    return F.when(text.isNull() | query.isNull(), F.lit(0.0)).otherwise(let(tokens(text), total))


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the larger number of distinct words; 0 where a text is null."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.greatest(F.size(x), F.size(y))), F.lit(0.0))


def keyword_hits(task: Column, words: Column) -> Column:
    """How many of the task's words, with repeats, are among ``words`` (an array)."""
    return F.size(F.filter(tokens(task), lambda w: F.array_contains(words, w)))


def line_count(text: Column) -> Column:
    """Lines, a null text having none and an empty one a single line."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1)))


def line_counts(text: Column) -> Column:
    """struct(code, comments, blank): lines starting with // or /* are comments."""
    lines = F.transform(F.split(text, "\n", -1), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")))
    blank = F.size(F.filter(lines, lambda s: s == ""))
    comments = F.size(F.filter(lines, lambda s: s.startswith("//") | s.startswith("/*")))
    return F.when(text.isNotNull(), F.struct((F.size(lines) - blank - comments).alias("code"), comments.alias("comments"), blank.alias("blank")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def module_of(path: Column) -> Column:
    """The parent folder's name, 'root' where there is none."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("root")


def infer_capabilities(text: Column, words: dict[str, str], default: str) -> Column:
    """The capabilities whose word occurs in the text, else the default."""
    hits = F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(w)), F.lit(c)) for w, c in words.items()]))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))


def diff_range(old: Column, new: Column) -> Column:
    """struct(kind, first, old_last, new_last) of the lines that differ after equal lines at both ends are set aside.

    Lines count from 0; kind is 'none', 'added', 'deleted' or 'modified'; null texts count as empty.
    """
    a, b = F.split(F.coalesce(old, F.lit("")), "\n", -1), F.split(F.coalesce(new, F.lit("")), "\n", -1)
    same = lambda x, y: F.aggregate(  # noqa: E731  equal pairs before the first unequal one
        F.zip_with(F.slice(x, 1, F.least(F.size(x), F.size(y))), F.slice(y, 1, F.least(F.size(x), F.size(y))), lambda p, q: p == q),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, e: F.struct(F.when(s["on"] & e, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"],
    )
    head = same(a, b)
    tail = F.least(same(F.reverse(a), F.reverse(b)), F.least(F.size(a), F.size(b)) - head)
    old_last, new_last = F.size(a) - tail - 1, F.size(b) - tail - 1
    kind = F.when((old_last < head) & (new_last < head), "none").when(old_last < head, "added").when(new_last < head, "deleted").otherwise("modified")
    return F.struct(kind.alias("kind"), head.alias("first"), old_last.alias("old_last"), new_last.alias("new_last"))


def snippet(text: Column, first: int = 1, last: int = 100) -> Column:
    """Lines ``first`` to ``last``, from 1."""
    return F.array_join(F.slice(F.split(text, "\n", -1), first, last - first + 1), "\n")


# -- rewriting of code -----------------------------------------------------------------------------


def var_to_const(code: Column) -> Column:
    return F.regexp_replace(code, r"\bvar\s+(\w+)\s*=", r"const $1 =")


def drop_console(code: Column) -> Column:
    return F.regexp_replace(code, r"console\.(log|warn|error|info|debug)\([^)]*\);?\n?", "")


def ticket_todos(code: Column) -> Column:
    return F.regexp_replace(code, r"(?m)//\s*(TODO|FIXME):?[ \t]*(.*)$", r"// $1: [AUTO-TICKET] $2")


def sort_imports(code: Column) -> Column:
    """Distinct import lines, sorted, before a blank line and the rest in order; a text without any stays as it is."""
    lines = F.split(code, "\n", -1)
    imports = F.array_sort(F.array_distinct(F.filter(lines, lambda s: F.ltrim(s).startswith("import "))))
    rest = F.filter(lines, lambda s: ~F.ltrim(s).startswith("import "))
    return F.when(F.size(imports) > 0, F.array_join(F.concat(imports, F.array(F.lit("")), rest), "\n")).otherwise(code)


# fixed values: name, pattern that calls for it, rewrite; the first that matches applies
CODEMODS = (
    ("const-conversion", r"\bvar\s+\w+\s*=", var_to_const),
    ("remove-console", r"console\.(log|warn|error|info|debug)\(", drop_console),
    ("sort-imports", r"(?m)^import .*\n(.*\n)*?import ", sort_imports),
    ("add-ticket-to-todo", r"//\s*(TODO|FIXME)", ticket_todos),
)


def match_codemod(code: Column) -> Column:
    """Name of the first rewrite that the code calls for, or null."""
    return F.coalesce(*[F.when(code.rlike(pattern), F.lit(name)) for name, pattern, _ in CODEMODS])


def apply_codemod(code: Column) -> Column:
    out = code
    for _, pattern, rewrite in reversed(CODEMODS):
        out = F.when(code.rlike(pattern), rewrite(code)).otherwise(out)
    return out


# -- templates and sentences ---------------------------------------------------------------------------


def render(template: Column, values: Column, defaults: Column | None = None) -> Column:
    """``{{name}}`` replaced from a map of values, then from one of defaults; unknown names stay."""
    put = lambda text, entries: F.aggregate(entries, text, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))
    out = put(template, F.map_entries(values))
    return out if defaults is None else put(out, F.map_entries(defaults))


def template_names(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{([A-Za-z0-9_]+)\}\}"), F.lit(1)))


def variable_state(value: Column, default: Column, required: Column) -> Column:
    """'given', 'default', or without either 'missing' if required, else 'empty'."""
    return F.when(value.isNotNull(), "given").when(default.isNotNull(), "default").when(required, "missing").otherwise("empty")


def title_of_steps(actions: Column) -> Column:
    """Distinct first words of the actions, joined."""
    return F.concat(F.array_join(F.array_distinct(F.transform(actions, lambda a: F.split_part(a, F.lit("_"), F.lit(1)))), " + "), F.lit(" Strategy"))


def describe_steps(actions: Column, reward: Column) -> Column:
    return F.concat(F.lit("Steps: "), F.array_join(actions, " → "), F.lit(". Reward: "), F.format_string("%.2f", reward))


# fixed values: what a change is called by its kind, and what its decision says
PREFIXES = {"added": "Introduce", "renamed": "Refactor", "deleted": "Update dependency"}
DECISIONS = {
    "renamed": "Refactor the identified code to improve maintainability and reduce technical debt.",
    "added": "Create a new module with clear boundaries and well-defined interfaces.",
    "deleted": "Update the dependency to the specified version with compatibility checks.",
}


def decision_title(kind: Column, file: Column, description: Column) -> Column:
    """Prefix by kind, the file's own name ('system' without one) and 50 characters of the description."""
    prefix = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in PREFIXES.items()], F.lit("Change"))
    name = F.when(file.isNull(), "system").otherwise(F.element_at(F.split(file, "/"), -1))
    return F.concat(prefix, F.lit(" "), name, F.lit(": "), F.left(F.coalesce(description, F.lit("")), F.lit(50)))


def context_section(trigger: Column, n_files: Column, modules: Column) -> Column:
    return F.concat(F.lit("## Context\n\n**Trigger:** "), F.coalesce(trigger, F.lit("")), F.lit("\n**Affected Files:** "), n_files.cast("string"), F.lit("\n**Affected Modules:** "), F.array_join(modules, ", "))


def decision_section(kind: Column) -> Column:
    return F.concat(F.lit("## Decision\n\n"), F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in DECISIONS.items()], F.lit("Apply the necessary changes.")))


def effort(n_files: Column, weight: Column) -> Column:
    """Two weighted hours a file as hours, days of 8 or weeks of 40."""
    hours = n_files * 2 * weight
    return F.when(hours < 8, F.concat(F.ceil(hours).cast("string"), F.lit(" hours"))).when(hours < 40, F.concat(F.ceil(hours / 8).cast("string"), F.lit(" days"))).otherwise(F.concat(F.ceil(hours / 40).cast("string"), F.lit(" weeks")))


# fixed values: points and patterns
UNSAFE = (
    (30, r"""(?i)api[_-]?key\s*[:=]\s*['"][^'"]+['"]"""),
    (30, r"""(?i)password\s*[:=]\s*['"][^'"]+['"]"""),
    (30, r"""(?i)secret\s*[:=]\s*['"][^'"]+['"]"""),
    (30, r"""(?i)token\s*[:=]\s*['"][^'"]+['"]"""),
    (20, r"""query\s*\(\s*['"].*\$\{.*\}.*['"]"""),
    (20, r"""execute\s*\(\s*['"].*\$\{.*\}.*['"]"""),
    (15, r"innerHTML\s*="),
    (15, r"dangerouslySetInnerHTML"),
)


def code_findings(code: Column) -> Column:
    """Points lost for patterns of unsafe code, each once: 30 for a literal secret, 20 for SQL put together from parts, 15 for markup written unescaped."""
    return sum((F.when(code.rlike(p), F.lit(n)).otherwise(0) for n, p in UNSAFE), F.lit(0))


def code_issues(code: Column) -> Column:
    """How many of the patterns of unsafe code occur; null counts none."""
    return sum((F.when(code.rlike(p), 1).otherwise(0) for _, p in UNSAFE), F.lit(0))
