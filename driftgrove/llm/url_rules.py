"""URL filters: host and path rules first, then pattern rules found through their rarest literal token.

A pattern rule is a regular expression over the lower-cased URL. Its literal tokens are the
``\\bword\\b`` parts outside groups; each must occur as a token of any URL that matches. The rule is
indexed by the one that the fewest URLs of the corpus hold. The tokens of a URL fetch candidate
rules, and only those run their regular expressions; rules without literal tokens always run.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrove.llm.common import map_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are sent to all executors; so many at most.
MAX_RULES = 200_000


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)
#: Patterns that block what no host rule decides.
PATTERN_RULES = (
    r"://[^/]*\badult\b",
    r"://[^/]*\bspam\b",
    r"://[^/]*\bspam\b-\bfarm\b",
    r"://[^/]*\bcasino\b",
    r"://[^/]*\bporn\b",
    r"://[^/]*\bxxx\b",
    r"://[^/]*\bbetting\b",
    r"://[^/]*\bescort\b",
    r"://[^/]*\bmalware\b",
    r"://[^/]*\bphishing\b",
    r"\bviagra\b",
    r"\bwarez\b",
    r"\btorrent\b/[0-9a-z]+",
    r"/\badult\b/",
    r"/\bgambling\b/",
    r"\bfree\b-\bdownload\b",
    r"://[^/]*\bads\b[0-9]*\.",
    r"://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}[:/]",
)
FIELDS = [T.StructField("pattern", T.StringType())]


def class_end(pattern: str, at: int) -> int:
    """Where the character class that opens at ``at`` is over; the pattern's end if it never closes."""
    i = at + 1 + pattern[at + 1 :].startswith("^")
    i += pattern[i : i + 1] == "]"
    while i < len(pattern) and pattern[i] != "]":
        i += 2 if pattern[i] == "\\" else 1
    return min(i + 1, len(pattern))


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that any match must hold: ``\\bword\\b`` outside groups; none where there is a choice at the top.

    The pattern is walked once: a token is a boundary, letters or digits that stand for themselves, and a
    boundary that isn't quantified. Verbose patterns, which may have comments, have none.
    """
    if re.search(r"\(\?[a-zA-Z]*x", pattern):
        return []
    depth, word, found, i = 0, None, [], 0
    while i < len(pattern):
        c = pattern[i]
        end = i + 2 if c == "\\" else class_end(pattern, i) if c == "[" else i + 1
        if c == "|" and not depth:
            return []
        depth += (c == "(") - (c == ")")
        if depth or c == ")":
            word = None
        elif pattern[i:end] == "\\b":
            if word and pattern[end : end + 1] not in ("*", "?", "{", "+"):
                found.append(word)
            word = ""
        else:
            word = word + c if word is not None and c in "abcdefghijklmnopqrstuvwxyz0123456789" else None
        i = end
    return found


def tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "[^a-z0-9]+"))


def token_counts(urls: DataFrame, wanted: Sequence[str], url: str = "url") -> dict[str, int]:
    """URLs that hold each of the wanted tokens; as many rows come back as tokens are wanted."""
    each = urls.select(F.explode(F.array_intersect(tokens(F.col(url)), F.array(*map(F.lit, wanted)))).alias("token"))
    return {r["token"]: r["n"] for r in each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def index_rules(patterns: Sequence[str], counts: Mapping[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """(rules by their rarest literal token, rules that have none); ties go to the longer, then the smaller token."""
    index: dict[str, list[int]] = {}
    always = []
    for i, p in enumerate(patterns):
        if found := literal_tokens(p):
            index.setdefault(min(found, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(i)
        else:
            always.append(i)
    return index, always


def match_patterns(urls: DataFrame, patterns: Sequence[str] = PATTERN_RULES, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns but ``url``) with ``pattern``: the first of the patterns that the URL matches, or null.

    A null URL matches nothing. Letters A to Z of the URL count as lower case. Rows that repeat are
    matched each on their own, an empty table gives an empty result, and a column of ``urls`` named
    ``pattern`` gives way to the new one. A task compiles a rule when a URL first fetches it, once; a rule
    that isn't a regular expression is an error then.
    """
    if len(patterns) > MAX_RULES:
        raise ValueError(f"{MAX_RULES} rules at most")
    wanted = sorted({t for p in patterns for t in literal_tokens(p)})
    index, always = index_rules(patterns, token_counts(urls, wanted, url) if wanted else {})
    lower = str.maketrans(UPPER, LOWER)

    compiled: dict[int, re.Pattern] = {}  # of the task: each has its own copy

    def rule(i: int) -> re.Pattern:
        if i not in compiled:
            compiled[i] = re.compile(patterns[i], re.ASCII)
        return compiled[i]

    def run(texts: pa.Array) -> list[pa.Array]:
        split = re.compile("[^a-z0-9]+").split
        out = []
        for t in texts.to_pylist():
            t = (t or "").translate(lower)
            candidates = sorted({*always, *(i for token in set(split(t)) for i in index.get(token, ()))}) if t else []
            out.append(next((patterns[i] for i in candidates if rule(i).search(t)), None))
        return [pa.array(out, pa.string())]

    return map_text(urls, run, FIELDS, url, keep)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)", 2)


def judge(pages: DataFrame, rules: Sequence[HostRule] = HOST_RULES, patterns: Sequence[str] = PATTERN_RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, pattern of every row.

    The longest host rule that fits decides; where none does, a matching pattern blocks and
    anything else is allowed. A null URL, or one without ``://``, has empty host and path.
    """
    found = match_patterns(pages.select(key, url, F.col(url).alias("__url")), patterns, url)
    host, path = host_of(F.col("__url")), path_of(F.col("__url"))
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
    no_rule = F.lit(None).cast("string")
    rule = F.coalesce(*[F.when(fits(r), F.lit(r.name)) for r in ordered], no_rule)
    ruled = F.coalesce(*[F.when(fits(r), F.lit(r.verdict)) for r in ordered], no_rule)
    by_pattern = F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")
    return found.select(key, host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(ruled, by_pattern).alias("verdict"), "pattern")
