"""What a source text declares, told by its lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTION = r"(?m)^\s*(?:export\s+)?(?:async\s+)?(?:function|def|fn|func)\s+([A-Za-z_]\w*)"
CLASS = r"(?m)^\s*(?:export\s+)?(?:abstract\s+)?(?:class|struct|interface)\s+([A-Za-z_]\w*)"
IMPORT = r"""(?m)^\s*(?:import\s[^'"\n]*?from\s*|import\s+|from\s+)['"]?([@\w./\-]+)"""


ANY_FUNCTION = r"(?:function|def|fn|func)\s+\w+\s*\("
PARAMETERS = r"(?:function|def|fn|func)\s+\w+\s*\(([^()\n]*)\)"


def parameters(code: Column) -> Column:
    """Of every function on one line its parameters, as an array of arrays; null for a null text."""
    lists = F.regexp_extract_all(code, F.lit(PARAMETERS), F.lit(1))
    return F.transform(lists, lambda p: F.filter(F.transform(F.split(p, ","), lambda a: F.trim(a)), lambda a: a != ""))


def signature(params: Column) -> Column:
    """The types of parameters, or the names of those without one, joined by commas."""
    kind = lambda a: F.when(a.rlike(r":\s*[^=]+"), F.trim(F.regexp_extract(a, r":\s*([^=]+)", 1))).otherwise(F.trim(F.regexp_extract(a, r"^([^:=]*)", 1)))
    return F.array_join(F.transform(params, kind), ",")


def functions(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(FUNCTION), F.lit(1))


def classes(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(CLASS), F.lit(1))


def imports(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(IMPORT), F.lit(1))


def branches(code: Column) -> Column:
    """Branching keywords and operators, plus one: an estimate of cyclomatic complexity; null for a null text."""
    return F.regexp_count(code, F.lit(r"\b(if|elif|for|while|case|catch|except)\b|&&|\|\||\?(?![.?:])")) + 1
