"""Credentials in patches, and patches with them masked.

A literal is cut into dictionary words, digits and separators by Viterbi; what no word explains is its residual.
A long residual near an assignment is a credential, unless it has the form of a hash, an identifier or encoded
data; where the name assigned to says that a credential follows, a short residual or a pass phrase is enough.
The dictionary is the corpus's own: words that many patches use.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINDING = "array<struct<line_no:int,kind:string,start:int,stop:int>>"

# -- the dictionary --------------------------------------------------------------------------------

#: A word belongs to the dictionary if this share of the patches, and at least two, use it. So the dictionary has at
#: most (distinct words of a patch on average) / WORD_SHARE words, however many patches there are.
WORD_SHARE, WORD_LENGTH = 0.005, 4


def dictionary(patches: DataFrame, text: str) -> set[str]:
    """Words of at least WORD_LENGTH letters used by a share of all patches, counted over all of them."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"[A-Z]?[a-z]{{{WORD_LENGTH - 1},}}|[A-Z]{{{WORD_LENGTH},}}"), F.lit(0)), lambda w: F.lower(w)))
    rows = patches.where(F.col(text).isNotNull())
    n = rows.count()
    used = rows.select(F.explode(words).alias("w")).where(F.length("w").between(WORD_LENGTH, 24)).groupBy("w").count().where(F.col("count") >= max(2, WORD_SHARE * n))
    return {r.w for r in used.select("w").collect()}


class Segmenter:
    """Least unexplained characters of a literal."""

    def __init__(self, words: set[str]):
        self.words = words
        self.longest = max(map(len, words), default=0)
        self.residual = lru_cache(50_000)(self._residual)

    def _residual(self, literal: str) -> int:
        low, n = literal.lower(), len(literal)
        best = [0.0] + [1e9] * n  # cost of the best path; an unexplained character costs 1, a word little
        plain = [0] * (n + 1)
        for i in range(n):
            ch = literal[i]
            explained = not ch.isalnum()
            if best[i] + (0.01 if explained else 1.0) < best[i + 1]:
                best[i + 1], plain[i + 1] = best[i] + (0.01 if explained else 1.0), plain[i] + (not explained)
            if ch.isdigit() and (i == 0 or not literal[i - 1].isalnum() or literal[i - 1].isalpha()):
                j = i
                while j < n and literal[j].isdigit():
                    j += 1
                if j - i <= 6 and (j == n or not literal[j].isalpha()) and best[i] + 0.3 < best[j]:
                    best[j], plain[j] = best[i] + 0.3, plain[i]
            if ch.isalpha() and (i == 0 or not literal[i - 1].isalpha() or ch.isupper() or literal[i - 1].islower()):
                for size in range(WORD_LENGTH, min(self.longest, n - i) + 1):
                    if low[i : i + size] in self.words and best[i] + 0.2 < best[i + size]:
                        body = literal[i + 1 : i + size]
                        if body.islower() or literal[i : i + size].isupper():
                            best[i + size], plain[i + size] = best[i] + 0.2, plain[i]
        return plain[n]


# -- fixed values: names and forms -----------------------------------------------------------------

SECRET_NAME = re.compile(
    r"(passwords?|passwd|passphrase|pwd|secret|secrets|token|credentials?|authorization|auth|apikey|smtppass|dbpass|userpass|"
    r"(api|access|private|secret|signing|encryption|encrypt|master|auth|service|client|deploy|ssh|account|shared|storage|hmac|license|rsa|webhook)key)$"
)
SECRET_WORDS = {"pass"}  # only as a whole last word
HASH_NAME = re.compile(r"(sha\d*|md5|hash|checksum|digest|etag|integrity|fingerprint|commit|revision|rev|uuid|guid|traceid|requestid|buildid|tenant|sessionref|nonce|publickey|cert|certificate|logo|pixel|icon|image)$")
PLACEHOLDER = re.compile(
    r"(?i)^(|x{3,}|\*+|\.{2,}|-+|_+|#+|0+|<.*>|\[.*\]|\(.*\)|%\w+%|none|null|nil|undefined|true|false|yes|no|todo|tbd|fixme|n/?a|example|sample|dummy|fake|test|testing|secret|password|passwd|token|"
    r"change[ _-]?(me|it|this)|replace[ _-]?(me|this|with.*)|place[ _-]?holder|redacted|masked|hidden|removed|your[ _-].*|my[ _-](secret|password|token|key).*|insert[ _-].*|put[ _-].*|enter[ _-].*|set[ _-].*|(some|any)[ _-].*|default|foo|bar|foobar|abc123|123456\d*)$"
)
REFERENCE = re.compile(
    r"(\$\{|\$\(|\{\{|<%|%\{|#\{|^\$[A-Za-z_]|^@[A-Za-z]|\b(os\.environ|process\.env|getenv|environ|ENV(\.fetch)?[\[(]|System\.|secrets\.|vault[./:]|ssm:|arn:|keyring|config\.|settings\.|env\.|var\.|self\.|this\.|params\.|args\.|import\.meta|Rails\.|Deno\.))"
)
UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
HASH_VALUE = re.compile(r"(?i)^(sha\d+|md5|blake2b?)[-:=][A-Za-z0-9+/=]{16,}$|^\$2[aby]\$|^\$argon2|^\$[156]\$")
HEX_HASH = re.compile(r"(?i)^[0-9a-f]{32}$|^[0-9a-f]{40}$|^[0-9a-f]{56}$|^[0-9a-f]{64}$|^[0-9a-f]{96}$|^[0-9a-f]{128}$")
KNOWN = re.compile(
    r"(?<![A-Za-z0-9_\-])("
    r"gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w\-]{18,}|xox[abeoprs]-[\w\-]{16,}|(?:sk|rk)_(?:live|test|prod)_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{40,}|"
    r"SG\.[\w\-]{16,}\.[\w\-]{16,}|AIza[\w\-]{30,}|(?:AKIA|ASIA)[A-Z0-9]{16}|eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]*|pypi-[\w\-]{20,}|hvs\.[\w\-]{20,}|dckr_pat_[\w\-]{20,}|sk-[A-Za-z0-9\-]{20,}|shpat_[a-f0-9]{32}|ya29\.[\w\-]{20,}|"
    r"[a-z]{2,12}_(?:pk|sk|pat|key|secret|token)_[A-Za-z0-9]{24,})"
)
PHRASE = re.compile(r"^[A-Z][a-z]+[^A-Za-z0-9\s/][A-Z][a-z]+[^A-Za-z0-9\s/]?\d+\W?$")
URL_LOGIN = re.compile(r"[A-Za-z][\w+.\-]*://[^\s/:@'\"`<>]*:([^\s'\"`<>]+?)@(?=[\w\[.\-])")
URL_PARAM = re.compile(r"[?&](?:[\w.\-]*(?:key|token|secret|pass|passwd|password|pwd|sig|signature|auth|credential))=([^\s&'\"`#<>]+)", re.I)
CURL_LOGIN = re.compile(r"(?:\s-u\s*|--user[ =])['\"]?[^\s:'\"]+:([^\s'\"]+)")
NETRC_LOGIN = re.compile(r"\blogin\s+\S+\s+password\s+(\S+)")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
SCHEME = re.compile(r"^(?:Bearer|Basic|Token|Digest|ApiKey)\s+", re.I)

_NAME = r"[A-Za-z_:$][\w$.\-]*"
_SIGN = r"(?:\?\?=|\|\|=|:=|=>|==?|:)"
QUOTED = re.compile(rf"({_NAME})[\"'`\]\)]*\s*(?::\s*&?[\w<>\[\]']+\s*(?=[=]))?{_SIGN}\s*[A-Za-z]?([\"'`])(.*?)\2")
BARE = re.compile(rf"({_NAME})[\"'`\]]*\s*{_SIGN}\s*((?:Bearer|Basic|Token)\s+[^\s\"'`]+|[^\s\"'`]+)")
CALL = re.compile(rf"[\"'`]({_NAME})[\"'`]\s*,\s*([\"'`])(.*?)\2")
XML_ATTR = re.compile(r"(?:name|key|id)\s*=\s*[\"']([\w.\-]+)[\"']\s+value\s*=\s*([\"'])(.*?)\2", re.I)
XML_TAG = re.compile(r"<([\w.\-]+)(?:\s[^<>]*)?>()([^<>]+)</\1>")
SAID = re.compile(rf"`({_NAME})`\s+(?:set to|is|=|to)\s+(`)(.*?)`")
PROSE = re.compile(r"\b((?:api|access|auth|signing|encryption|private)[ _-]?key|pass(?:word|phrase|wd)?|pwd|token|secret|credentials?)()\s*(?:is|was|=|:|->)\s*[\"'`]?([^\s\"'`]+)", re.I)
JOINT = re.compile(r"([\"'`])\s*[+.]\s*\1|([\"'`])\s+\2(?=[A-Za-z0-9])")

# What every finding needs in its line, pattern by pattern; a line with none of it is passed over unread.
#: All that SECRET_NAME, SECRET_WORDS, NETRC_LOGIN and PEM can match holds one of these once the line is flattened as names are.
STEMS = re.compile(r"pass|pwd|secret|token|credential|auth|key")
#: A literal put together from parts, and what the patterns that need no name begin with.
CUES = (JOINT, KNOWN, URL_PARAM, re.compile(r"://|\s-u|--user"))
#: A literal that is taken without a telling name is such a run, with letters of both cases and digits.
LONG = re.compile(r"[A-Za-z0-9+/=_\-.~]{24,}")
_DIGIT = re.compile(r"[0-9]")
_FLAT = re.compile(r"[^a-z0-9\n]+")


def _mixed(text: str) -> bool:
    return any(_DIGIT.search(run) and not run.islower() and not run.isupper() for run in LONG.findall(text))


def _body(line: str) -> str:
    """Without the mark of an added, removed or context line."""
    return line[1:] if line[:1] in ("+", "-", " ") else line


def _last_word(name: str) -> str:
    return re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)[-1:][0].lower() if re.search(r"[A-Za-z]", name) else ""


@lru_cache(100_000)
def name_kind(name: str) -> str:
    """'secret' if the name says that a credential follows, 'other' if it says something else is, '' if nothing."""
    flat = re.sub(r"[^a-z0-9]", "", name.lower())
    if HASH_NAME.search(flat):
        return "other"
    last = _last_word(name)
    if SECRET_NAME.search(flat) and not (last == "auth" and len(flat) > 8):
        return "secret"
    return "secret" if last in SECRET_WORDS or flat in SECRET_WORDS else ""


class Finder:
    """Finds credentials in one patch."""

    def __init__(self, words: set[str], skip: bool = True):
        """``skip``: pass over lines that cannot hold a finding, without a change to the result."""
        self.seg, self.skip = Segmenter(words), skip

    def live(self, value: str, kind: str) -> bool:
        """Whether a literal assigned to a name of this kind is a usable-looking credential."""
        value = SCHEME.sub("", value.strip()).strip("\"'`;,")
        if PLACEHOLDER.match(value) or REFERENCE.search(value) or len(set(value)) <= 2:
            return False
        if HASH_VALUE.match(value) or re.match(r"(?i)^(data|https?|file|urn|mailto):", value) or re.search(r"\s", value):
            return False
        if kind == "secret":
            if value.isdigit() or len(value) < 6 or re.match(r"^[\w.]+\(", value) or "(" in value or "[" in value and "]" in value:
                return False
            if self.seg.residual(value) >= 4:
                return True
            # a pass phrase of words, signs and digits
            return bool(PHRASE.match(value) or re.search(r"\d", value) and re.search(r"[^\w\s./\-]", value))
        if kind == "other" or UUID.match(value) or HEX_HASH.match(value):
            return False
        body = re.sub(r"[^A-Za-z0-9]", "", value)
        classes = bool(re.search(r"[a-z]", body)) + bool(re.search(r"[A-Z]", body)) + bool(re.search(r"\d", body))
        return bool(len(body) >= 24 and classes == 3 and self.seg.residual(value) >= 20 and re.fullmatch(r"[A-Za-z0-9+/=_\-.~]+", value))

    def in_line(self, line: str) -> list[tuple[str, int, int]]:
        """(kind, start, stop) within the line."""
        found: list[tuple[str, int, int]] = []

        def add(kind: str, a: int, b: int) -> None:
            if b > a and not any(x < b and a < y for _, x, y in found):
                found.append((kind, a, b))

        if JOINT.search(line):  # a literal put together from parts
            joined = JOINT.sub("", line)
            for m in QUOTED.finditer(joined):
                if self.live(m[3], name_kind(m[1])) or KNOWN.search(m[3]):
                    parts = [p.span(2) for p in re.finditer(r"([\"'`])(.*?)\1", line) if p[2] and p[2] in m[3]]
                    for a, b in parts:
                        add("assignment", a, b)
        for m in KNOWN.finditer(line):
            if self.seg.residual(m[1]) >= 10 and not PLACEHOLDER.match(m[1]):
                add("token", *m.span(1))
        for pattern, kind in ((URL_LOGIN, "login"), (CURL_LOGIN, "login"), (NETRC_LOGIN, "login"), (URL_PARAM, "parameter")):
            for m in pattern.finditer(line):
                if self.live(m[1], "secret"):
                    add(kind, *m.span(1))
        for pattern in (QUOTED, CALL, XML_ATTR, XML_TAG, SAID, PROSE):
            for m in pattern.finditer(line):
                if self.live(m[3], name_kind(m[1])):
                    add("assignment", *m.span(3))
        for m in BARE.finditer(line):
            if m[2][:1] not in "\"'`" and self.live(m[2], name_kind(m[1])):
                add("assignment", *m.span(2))
        return found

    def __call__(self, patch: str) -> list[tuple[int, str, int, int]]:
        """(line number from 1, kind, start, stop) with places in the patch; one over several lines comes once a
        line, the first line first, its later lines with kind 'continued'."""
        lines = patch.split("\n")
        starts = [0]
        for text in lines[:-1]:
            starts.append(starts[-1] + len(text) + 1)
        flat = _FLAT.sub("", patch.lower()).split("\n")  # line by line what a name is flattened to
        hot = (n for n, text in enumerate(lines, 1) if not self.skip or STEMS.search(flat[n - 1]) or _mixed(text) or any(c.search(_body(text)) for c in CUES))
        ends = [*(s - 1 for s in starts[1:]), len(patch)]
        out: list[tuple[int, str, int, int]] = []
        in_pem = 0
        for n in hot:
            if n <= in_pem:
                continue
            a = starts[n - 1]
            line = patch[a : ends[n - 1]]
            if line.startswith("@@"):
                continue
            if m := PEM.search(line):
                spans, in_pem = self.pem(patch, starts, ends, n, a + m.end())
                out += spans
                continue
            at = a + len(line) - len(_body(line))
            out += [(n, k, at + x, at + y) for k, x, y in sorted(self.in_line(_body(line)), key=lambda f: f[1])]
        return out

    def pem(self, patch: str, starts: list[int], ends: list[int], n: int, at: int) -> tuple[list[tuple[int, str, int, int]], int]:
        """The body of a private key whose BEGIN is on line n and ends at ``at``, and the last line of it."""
        spans: list[tuple[int, str, int, int]] = []
        size, last = 0, n
        if end := PEM_END.search(patch, at, ends[n - 1]):  # all on one line
            body = re.sub(r"\\[nr]|\s", "", patch[at : end.start()])
            return ([(n, "private key", at, end.start())] if self._encoded(body) else []), n
        if patch[at : ends[n - 1]].strip(" \r\"'\\n+,"):
            spans.append((n, "private key", at, ends[n - 1]))
            size += ends[n - 1] - at
        for k in range(n + 1, len(starts) + 1):
            a, b = starts[k - 1], ends[k - 1]
            line = patch[a:b].rstrip("\r")
            text = line[1:] if line[:1] in "+- " and line else line
            if PEM_END.search(text):
                last = k
                break
            core = re.sub(r"^[\s\"'#*/]+|[\s\"'\\,+;]+$|\\n", "", text)
            if re.match(r"^[A-Za-z\-]+: ", core) or not core:  # a header of an encrypted key
                last = k
                continue
            if not re.fullmatch(r"[A-Za-z0-9+/=]+", core):
                break
            i = patch.find(core, a)
            spans.append((k, "continued", i, i + len(core)))
            size += len(core)
            last = k
        body = "".join(patch[x:y] for _, _, x, y in spans)
        if not spans or not self._encoded(re.sub(r"\\[nr]|\s", "", body)):
            return [], last
        if spans[0][0] != n:
            spans.insert(0, (n, "private key", at, at))
        else:
            spans[0] = (n, "private key", *spans[0][2:])
        return spans, last

    @staticmethod
    def _encoded(body: str) -> bool:
        return len(body) >= 32 and len(set(body)) >= 12 and not PLACEHOLDER.match(body)


# -- operators -------------------------------------------------------------------------------------


def mask(text: str, found: list[tuple[int, str, int, int]]) -> str:
    """The text with every finding overwritten by asterisks, one for each character; all else, lengths included, stays."""
    parts, at = [], 0
    for _, _, start, stop in sorted(found, key=lambda f: f[2:]):
        start = max(start, at)
        parts += [text[at:start], "*" * (stop - start)]
        at = max(at, stop)
    return "".join([*parts, text[at:]])


def scan(files: DataFrame, text: str, words: set[str], masked: bool = False) -> DataFrame:
    """``files`` with ``findings``: an array of (line_no, kind, start, stop), null texts giving none; if asked for, ``text`` is masked."""
    known = files.sparkSession.sparkContext.broadcast(words)  # see WORD_SHARE for its bound
    names = ("line_no", "kind", "start", "stop")

    @F.pandas_udf(f"findings {FINDING}, masked string" if masked else f"findings {FINDING}")
    def findings(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = Finder(known.value)
        for texts in batches:
            found = [[] if t is None else find(t) for t in texts]
            out = pd.DataFrame({"findings": [[dict(zip(names, f, strict=True)) for f in fs] for fs in found]}, dtype=object)
            if masked:
                out["masked"] = pd.Series([t if t is None else mask(t, fs) for t, fs in zip(texts, found, strict=True)], dtype=object)
            yield out

    out = files.withColumn("__s", findings(F.col(text))).withColumn("findings", F.col("__s.findings"))
    return (out.withColumn(text, F.col("__s.masked")) if masked else out).drop("__s")


def _files(files: DataFrame) -> DataFrame:
    return files.select("pr_file_id", "filename", "patch")


def redact(files: DataFrame) -> DataFrame:
    """One row per row of ``files``: ``pr_file_id, filename, n_findings`` (a credential over several lines counts once) and ``patch``, masked."""
    got = scan(_files(files), "patch", dictionary(files, "patch"), masked=True)
    first = F.filter("findings", lambda f: f["kind"] != "continued")
    return got.select("pr_file_id", "filename", F.size(first).alias("n_findings"), "patch")


def report(files: DataFrame) -> DataFrame:
    """One row per credential: ``pr_file_id, filename, line_no, kind``; redelivered rows report once."""
    some = files.where("patch IS NOT NULL")
    got = scan(_files(some), "patch", dictionary(files, "patch")).where(F.size("findings") > 0)
    one = got.select("pr_file_id", "filename", F.explode("findings").alias("f")).where("f.kind <> 'continued'")
    return one.select("pr_file_id", "filename", "f.line_no", "f.kind", "f.start").distinct().drop("start")


def found(files: DataFrame) -> DataFrame:
    return report(files).select("pr_file_id", "line_no").distinct()
