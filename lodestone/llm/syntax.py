"""Source files that do not parse, from what their latest parse reports.

The text of the files is not kept; the reports are. A report is a token stream of its own, and whether it says
that the text breaks the grammar is decided by parsing it: a context-free grammar of such reports is matched by
derivatives. Each token takes the derivative of the language so far, remembered per (language, token); the
empty language marks the token at which a report stops being one about syntax, and a language that is not
nullable at the end marks a report that is cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.handwritten import latest, with_language

# -- parsing with derivatives --------------------------------------------------------------------------


class Lang:
    """A node of a language's graph. Nodes are shared, so a derivative is taken once per node and token."""

    __slots__ = ("kind", "a", "b", "memo", "null", "some")

    def __init__(self, kind: str, a=None, b=None):
        self.kind, self.a, self.b = kind, a, b
        self.memo: dict[str, Lang] = {}
        self.null: bool | None = None
        self.some: bool | None = None


EMPTY, EPS = Lang("empty"), Lang("eps")
_made: dict[tuple, Lang] = {}


def tok(*classes: str) -> Lang:
    key = ("tok", frozenset(classes))
    return _made.setdefault(key, Lang("tok", key[1]))


def cat(*parts: Lang) -> Lang:
    out = parts[-1]
    for p in reversed(parts[:-1]):
        if EMPTY in (p, out):
            return EMPTY
        out = out if p is EPS else p if out is EPS else _made.setdefault(("cat", id(p), id(out)), Lang("cat", p, out))
    return out


def alt(*parts: Lang) -> Lang:
    out = EMPTY
    for p in parts:
        if p is EMPTY or p is out:
            continue
        if out is EMPTY:
            out = p
        else:
            x, y = sorted((out, p), key=id)
            out = _made.setdefault(("alt", id(x), id(y)), Lang("alt", x, y))
    return out


def opt(p: Lang) -> Lang:
    return alt(p, EPS)


def rep(p: Lang) -> Lang:
    """p*, as the recursive language X = eps | p X."""
    x = Lang("ref")
    x.a = alt(EPS, cat(p, x))
    return x


def _fixed(lang: Lang, slot: str, base: tuple[str, ...]) -> bool:
    """The least fixed point, over the nodes that can be reached, of a property that holds for ``base`` kinds, for an
    alternative if for one part, and for a sequence if for both. Known values are kept in the nodes."""
    known = getattr(lang, slot)
    if known is not None:
        return known
    nodes: dict[int, Lang] = {}
    todo = [lang]
    while todo:
        n = todo.pop()
        if id(n) not in nodes:
            nodes[id(n)] = n
            if getattr(n, slot) is None:
                todo += [x for x in (n.a, n.b) if isinstance(x, Lang)]
    value = {i: bool(getattr(n, slot)) or n.kind in base for i, n in nodes.items()}
    changed = True
    while changed:
        changed = False
        for i, n in nodes.items():
            if not value[i] and getattr(n, slot) is None and n.kind in ("alt", "cat", "ref"):
                parts = [value[id(x)] for x in (n.a, n.b) if x is not None]
                if all(parts) if n.kind == "cat" else any(parts):
                    value[i] = changed = True
    for i, n in nodes.items():
        setattr(n, slot, value[i])
    return value[id(lang)]


def nullable(lang: Lang) -> bool:
    """Whether the empty stream belongs to the language."""
    return _fixed(lang, "null", ("eps",))


def possible(lang: Lang) -> bool:
    """Whether any stream belongs to the language."""
    return _fixed(lang, "some", ("eps", "tok"))


def derive(lang: Lang, token: str) -> Lang:
    if lang.kind in ("empty", "eps"):
        return EMPTY
    if lang.kind == "tok":
        return EPS if token in lang.a else EMPTY
    if token in lang.memo:
        return lang.memo[token]
    if lang.kind == "ref":  # the memo is set first, so that a left-recursive language meets itself
        out = lang.memo[token] = Lang("ref")
        out.a = derive(lang.a, token)
        if out.a.kind in ("empty", "eps", "tok"):
            lang.memo[token] = out.a
        return lang.memo[token]
    if lang.kind == "alt":
        out = alt(derive(lang.a, token), derive(lang.b, token))
    else:
        out = cat(derive(lang.a, token), lang.b)
        if nullable(lang.a):
            out = alt(out, derive(lang.b, token))
    lang.memo[token] = out
    return out


def parse(lang: Lang, tokens: list[str]) -> tuple[str, int]:
    """('accepted' | 'failed' | 'truncated', number of tokens taken)."""
    for i, t in enumerate(tokens):
        lang = derive(lang, t)
        if not possible(lang):
            return "failed", i
    return ("accepted" if nullable(lang) else "truncated"), len(tokens)


# -- the grammar of reports ----------------------------------------------------------------------------

# fixed values: words of reports by class
WORDS = {
    "FAULT": "unexpected unterminated unclosed unbalanced unmatched mismatched stray invalid illegal malformed extraneous incomplete dangling premature misplaced unrecognized unrecognised extra bad unindent inconsistent",
    "MISSING": "missing lacking",
    "EXPECTED": "expected expecting expects",
    "CANNOT": "cannot couldnt cant unable failed failure could can",
    "PARSE": "parse parsing parser tokenize tokenise tokenizing lex lexing lexer compile compiling",
    "ERROR": "error errors failure exception failed",
    "SYNTAX": "syntax syntaxerror parseerror grammar syntactic syntactically indentationerror taberror",
    "PLACE": "at near before after in on of inside within around from to for by",
    "ART": "a an the this any more another one",
    "NOT": "not no never isnt without",
    "BUT": "but got found reached encountered saw instead received while when",
    "END": "eof end ended ends",
    "UNIT": "token tokens input symbol symbols character characters char chars string strings literal literals bracket brackets brace braces paren parens parenthesis parentheses quote quotes quotation "
    "semicolon colon comma commas delimiter delimiters operator operators keyword keywords identifier indent indentation dedent statement statements expression expressions declaration block blocks "
    "comment heredoc template tag escape separator terminator newline regex regexp number numeral operand sequence marker markers merge file program source stream line nesting closing opening",
    "SIDE": "closing close opening open left right curly square round angle single double leading trailing multi multiline raw quoted matching",
    "STYLE": "type types return returns doc docs documentation import imports variable variables call calls default value values parameter parameters argument arguments whitespace tabs spaces module modules "
    "annotation docstring test tests header license copyright version config map timeout rule rules package dependency dependencies handler",
    "LIMIT": "most least longer larger limit limits exceeds exceeded budget timed timeout skipped fallback restarted deprecated shadowed unused",
    "CONFLICT": "conflict conflicts conflicting",
    "BE": "is was were are be has had have does",
}
_CLASS = {w: c for c, words in WORDS.items() for w in words.split()}
_TOKEN = re.compile(r"'[^']*'|\"[^\"]*\"|`[^`]*`|[A-Za-z][A-Za-z']*|\d+|[^\sA-Za-z0-9]")


def tokens(report: str) -> list[str]:
    """Classes of the report's tokens: Q a quoted text, N a number, P punctuation, W any other word."""
    out = []
    for t in _TOKEN.findall(report):
        if t[0] in "'\"`":
            out.append("Q" if len(t) > 1 else "P")
        elif t[0].isdigit():
            out.append("N")
        elif t[0].isalpha():
            out.append(_CLASS.get(t.lower().replace("'", ""), "W"))
        else:
            out.append("P")
    return out


def _grammar() -> Lang:
    every = ["Q", "N", "P", "W", *WORDS]
    rest = rep(tok(*every))
    art, p = rep(tok("ART")), rep(tok("P"))
    unit = cat(art, rep(tok("SIDE")), alt(tok("UNIT"), tok("END"), tok("Q")))
    of = cat(tok("PLACE"), unit)
    thing = Lang("ref")  # thing = unit | unit thing | unit of-thing
    thing.a = alt(unit, cat(unit, thing), cat(unit, rep(of)))
    sign = cat(rep(tok("P")), tok("P"))
    fault = cat(tok("FAULT"), alt(thing, tok("SYNTAX"), cat(tok("W"), tok("UNIT")), cat(tok("W"), tok("PLACE"), unit), cat(tok("BE"), tok("NOT"), rest), sign))
    faulty = cat(unit, tok("BE"), alt(tok("FAULT"), tok("MISSING")))
    not_a = cat(tok("NOT"), alt(cat(tok("ART"), thing), cat(tok("SIDE"), thing)))
    conflict = cat(rep(tok("UNIT")), tok("CONFLICT"), tok("UNIT"), rest)
    missing = cat(tok("MISSING"), alt(thing, sign))
    expected = alt(cat(tok("EXPECTED"), alt(thing, sign, cat(tok("W"), tok("UNIT")))), cat(opt(cat(tok("W"), tok("W"))), thing, tok("EXPECTED")))
    cannot = cat(alt(cat(tok("CANNOT"), opt(tok("NOT"))), cat(tok("BE"), tok("NOT"))), tok("PARSE"), alt(thing, cat(tok("PLACE"), rest), cat(tok("ART"), rest)))
    error = cat(alt(tok("PARSE"), tok("SYNTAX")), tok("ERROR"))
    syntax = cat(tok("SYNTAX"), p, alt(EPS, fault, tok("FAULT"), cat(tok("PLACE"), rest), missing, expected))
    premature = alt(cat(tok("END"), alt(cat(tok("PLACE"), thing), cat(tok("BUT"), rest))), cat(tok("BUT"), tok("END"), rest), cat(thing, tok("END"), tok("PLACE"), thing))
    not_closed = cat(thing, opt(tok("BE")), alt(cat(tok("NOT"), tok("SIDE", "W")), tok("FAULT")))
    core = alt(fault, faulty, missing, expected, cannot, error, syntax, premature, not_a, conflict, not_closed)
    tail = alt(EPS, cat(tok("P", "PLACE", "BUT", "Q", "N", "EXPECTED", "UNIT", "END"), rest))
    prefix = cat(rep(tok("W", "N", "P", "ART", "UNIT", "Q", "ERROR", "SYNTAX", "PLACE")), tok("P"))  # file:12:3: error:
    return alt(cat(core, tail), cat(prefix, core, tail))


GRAMMAR = _grammar()
#: Remembered nodes of languages; beyond them the memory starts afresh, as nested reports have derivatives without end.
MOST_NODES = 200_000


@lru_cache(100_000)
def _shape(shape: tuple[str, ...]) -> tuple[str, int]:
    global GRAMMAR
    if len(_made) > MOST_NODES:
        _made.clear()
        GRAMMAR = _grammar()
    return parse(GRAMMAR, list(shape))


def read(report: str | None) -> tuple[str, int, str | None]:
    """What a report turns out to be, the number of its tokens taken, and the token that failed: ('fault', n, None) if it
    says that the text is not valid in its language; ('other', i, token) if its token i (from 0) leaves no way to say so;
    ('cut off', n, None) if it ends before it has said anything of the kind. Null and empty reports are cut off."""
    if not report:
        return "cut off", 0, None
    outcome, n = _shape(tuple(tokens(report)))
    return {"accepted": "fault", "failed": "other", "truncated": "cut off"}[outcome], n, _TOKEN.findall(report)[n] if outcome == "failed" else None


def breaks_grammar(report: str | None) -> bool:
    """Whether a report says that the text is not valid in its language."""
    return read(report)[0] == "fault"


# -- operators -----------------------------------------------------------------------------------------


READ = "array<struct<outcome:string,at:int,token:string>>"


def outcomes(messages: Column) -> Column:
    """What each of an array of messages turns out to be, see :func:`read`; null for a null array."""

    @F.pandas_udf(READ)
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("outcome", "at", "token")
        for rows in batches:
            yield pd.Series([None if r is None else [dict(zip(names, read(m), strict=True)) for m in r] for r in rows])

    return each(messages)


def _read(parses: DataFrame, lang_ext: DataFrame) -> DataFrame:
    """One row per (``repo``, ``file``) of its latest parse: ``lang``, ``messages`` and what they turn out to be, ``read`` (null without messages)."""
    messages = F.transform("errors", lambda e: e["message"])
    files = with_language(latest(parses.withColumn("messages", messages), "language", "messages"), lang_ext).select("repo", "file", "lang", "messages")
    none = F.coalesce(F.size("messages"), F.lit(0)) <= 0
    some = files.where(~none).withColumn("read", outcomes(F.col("messages")))
    return some.unionByName(files.where(none).withColumn("read", F.lit(None).cast(READ)))


def flag(parses: DataFrame, lang_ext: DataFrame) -> DataFrame:
    """One row per (``repo``, ``file``): ``lang``, ``n_faults`` and ``valid``, by the file's latest parse.

    Of parses at one time the one ingested last, then the greatest ``parse_id`` counts. Null errors, null
    messages and empty messages report nothing. Null repos and files are values like others.
    """
    n = F.coalesce(F.size(F.filter("read", lambda r: r["outcome"] == "fault")), F.lit(0))
    every = _read(parses, lang_ext).withColumn("n_faults", F.greatest(n, F.lit(0)))
    return every.select("repo", "file", "lang", "n_faults", (F.col("n_faults") == 0).alias("valid"))


def reports(parses: DataFrame, lang_ext: DataFrame) -> DataFrame:
    """One row per report of a file's latest parse: ``repo, file, lang, report_no`` (from 0), ``message``, and with the meaning of :func:`read`
    ``outcome``, ``failed_at`` and ``failed_token`` (null unless the outcome is 'other'), and ``truncated``."""
    each = _read(parses, lang_ext).where("read IS NOT NULL").select("repo", "file", "lang", F.posexplode(F.arrays_zip("messages", "read")).alias("report_no", "z"))
    r, other = F.col("z.read"), F.col("z.read.outcome") == "other"
    return each.select(
        "repo", "file", "lang", "report_no", F.col("z.messages").alias("message"), r["outcome"].alias("outcome"), F.when(other, r["at"]).alias("failed_at"),
        r["token"].alias("failed_token"), (r["outcome"] == "cut off").alias("truncated"),
    )


def rates(parses: DataFrame, lang_ext: DataFrame) -> DataFrame:
    """Files, invalid files and their share per repository and language; a null ``lang`` stands for all of a repository, a null ``repo`` with ``all_repos`` for all."""
    sets = flag(parses, lang_ext).groupingSets([["repo", "lang"], ["repo"], ["lang"]], "repo", "lang")
    return sets.agg(
        F.grouping("repo").cast("boolean").alias("all_repos"), F.grouping("lang").cast("boolean").alias("all_langs"),
        F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"), F.avg((~F.col("valid")).cast("double")).alias("rate"),
    )


def found(parses: DataFrame, lang_ext: DataFrame) -> DataFrame:
    return flag(parses, lang_ext).where("NOT valid").select("repo", "file")
