"""Operator 8: URL filtering with pattern rules that are indexed by their rarest literal token.

The literal tokens that a match must hold are read off a rule's own pattern: it is taken apart into the ways in which it
can match, and each way has the runs of letters and digits that stand complete in it, between separators or word
boundaries. How often each token occurs in the URLs decides which of a way's is rarest, and the rule is filed under that
one for every way, so no match can miss it. A way without a complete token has the rule tried on every URL. A URL's own
tokens fetch the rules filed under them, and only those run their regular expression. Site rules (host and path prefix)
are found by equality on the host and each of its parent domains; the longest that fits decides before any pattern.

Defined cases: a null url or one without ``://`` has an empty host and path and is judged by the patterns alone; line
breaks are characters like any other; a null page_id is carried as it is, rows that repeat one are judged each for
itself; other columns are ignored; of equally long site rules the first one listed decides, of patterns the first too; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from re import _constants as S, _parser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SiteRule(NamedTuple):
    verdict: str
    host: str
    path: str


class PatternRule(NamedTuple):
    verdict: str
    pattern: str


# The site rules of the query's contract.
SITE_RULES = (
    SiteRule("block", "com", "/en/"),
    SiteRule("allow", "example.com", "/en/7"),
    SiteRule("allow", "net", "/de/"),
    SiteRule("block", "example.net", "/de/8"),
    SiteRule("block", "org", "/es/"),
)
PATTERN_RULES = (
    PatternRule("block", r"://[^/?#]*\bcasino\b"),
    PatternRule("block", r"://[^/?#]*\bpoker\b"),
    PatternRule("block", r"://[^/?#]*\b(?:free|online|sport|sports)-bets?\b"),
    PatternRule("block", r"://[^/?#]*\b(?:cheap|buy|online)-pills\b"),
    PatternRule("block", r"://[^/?#]*\bviagra\b"),
    PatternRule("block", r"://[^/?#]*\badult\b"),
    PatternRule("block", r"://[^/?#]*\bporn\b"),
    PatternRule("block", r"://[^/?#]*\bxxx\b"),
    PatternRule("block", r"://[^/?#]*\bspam\b"),
    PatternRule("block", r"://[^/?#]*\bads?-(?:track|server|click)"),
    PatternRule("block", r"://[^/?#]*\bpayday-loans?\b"),
    PatternRule("block", r"://[^/?#]*\bwarez\b"),
)
WAYS = 256  # ways of one pattern that are told apart; a pattern of more is tried on every URL


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


# Letters that a pattern without regard to case takes for s, i and k, and that lower() leaves or makes two of.
_LIKE_ASCII = str.maketrans("\u017f\u0131\u0130\u212a", "siik")


def tokens_of(url: str) -> set[str]:
    return set(re.split("[^a-z0-9]+", url.translate(_LIKE_ASCII).lower()))


_ANY, _EDGE = "any", "edge"  # of unknown length and content; a word boundary


def _ways(parsed) -> list[list[str]]:
    """The ways in which a parsed pattern can match, as characters, boundaries and unknown parts in order."""
    out: list[list[str]] = [[]]
    for op, arg in parsed:
        if op is S.LITERAL:
            c = chr(arg).lower()
            some = [[c if c.isascii() else _ANY]]
        elif op is S.AT:
            some = [[_EDGE]] if arg in (S.AT_BOUNDARY, S.AT_BEGINNING, S.AT_BEGINNING_STRING, S.AT_END, S.AT_END_STRING) else [[]]
        elif op is S.IN:
            plain = [chr(v) for o, v in arg if o is S.LITERAL]
            some = [[plain[0]]] if len(plain) == len(arg) and not any(c.isalnum() or not c.isascii() for c in plain) else [[_ANY]]
        elif op is S.BRANCH:
            some = [w for one in arg[1] for w in _ways(one)]
        elif op is S.SUBPATTERN:
            some = _ways(arg[-1])
        elif op is S.ATOMIC_GROUP:
            some = _ways(arg)
        elif op in (S.ASSERT, S.ASSERT_NOT):
            some = [[]]
        elif op in (S.MAX_REPEAT, S.MIN_REPEAT, S.POSSESSIVE_REPEAT):
            low, high, part = arg
            once = _ways(part)
            if any(c in (_ANY, _EDGE) or c.isalnum() for w in once for c in w) and high > 1:
                once = [[*w, _ANY] for w in once] if low else []
                some = once or [[_ANY]]
            else:
                some = once if low else [[], *once]
        else:
            some = [[_ANY]]
        out = [a + b for a in out for b in some]
        if len(out) > WAYS:
            return [[_ANY]]
    return out


def _complete(way: list[str]) -> set[str]:
    """The runs of letters and digits of a way with a separator or boundary on both sides."""
    found, run, clean = set(), "", False
    for c in [*way, _ANY]:
        if c not in (_ANY, _EDGE) and c.isalnum():
            run += c
            continue
        if run and clean and c != _ANY:
            found.add(run)
        run, clean = "", c != _ANY
    return found


def needed_tokens(pattern: str) -> list[set[str]]:
    """For each way in which ``pattern`` can match a set of tokens that every such match holds; it may be empty."""
    return [_complete([_ANY, *w]) for w in _ways(_parser.parse(pattern, re.I))]


def file_rules(patterns: Sequence[PatternRule], urls: DataFrame) -> dict[str | None, list[int]]:
    """Rule numbers by the rarest token of each of their ways over all URLs; under None those with a way without one. The
    counts fetched are those of the rules' own tokens, so they are bounded by the rules."""
    needed = [needed_tokens(p.pattern) for p in patterns]
    named = sorted({t for ways in needed for tokens in ways for t in tokens})
    tokens = urls.select(F.explode(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))).alias("token"))
    counts = {r["token"]: r["count"] for r in tokens.where(F.col("token").isin(named)).groupBy("token").count().collect()} if named else {}
    out: dict[str | None, list[int]] = {}
    for k, ways in enumerate(needed):
        under = {min(tokens, key=lambda t: (counts.get(t, 0), t), default=None) for tokens in ways}
        for token in {None} if None in under else under:
            out.setdefault(token, []).append(k)
    return out


def judge_urls(pages: DataFrame, sites: Sequence[SiteRule] = SITE_RULES, patterns: Sequence[PatternRule] = PATTERN_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (of a site, or null), verdict, pattern (that decided, or null) of every row."""
    index = file_rules(patterns, pages.select(F.col("url").cast("string").alias("url")))
    by_host: dict[str, list[SiteRule]] = {}
    for site in sites:
        by_host.setdefault(site.host, []).append(site)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [re.compile(p.pattern, re.I) for p in patterns]
        for pdf in batches:
            out = []
            for host, path, url in zip(pdf["host"], pdf["path"], pdf["url"], strict=True):
                fits, rest = [], host
                while rest:
                    fits += [s for s in by_host.get(rest, ()) if path.startswith(s.path)]
                    rest = rest.partition(".")[2]
                if fits:
                    best = max(fits, key=lambda s: len(s.host + s.path))
                    out.append((best.host + best.path, best.verdict, None))
                    continue
                tokens = tokens_of(url) if url else set()
                asked = sorted({k for t in (*tokens, None) for k in index.get(t, ())})
                hit = next((k for k in asked if compiled[k].search(url or "")), None)
                out.append((None, default if hit is None else patterns[hit].verdict, None if hit is None else patterns[hit].pattern))
            rule, verdict, pattern = zip(*out, strict=True) if out else ((), (), ())
            yield pd.DataFrame({"page_id": pdf["page_id"], "host": pdf["host"], "path": pdf["path"], "rule": pd.Series(rule, dtype=object, index=pdf.index), "verdict": pd.Series(verdict, dtype=object, index=pdf.index), "pattern": pd.Series(pattern, dtype=object, index=pdf.index)})

    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), url.alias("url"))
    return rows.mapInPandas(judge, "page_id string, host string, path string, rule string, verdict string, pattern string").withColumn("page_id", F.col("page_id").cast("long"))


_FITS = " ".join(
    f"WHEN (host = '{s.host}' OR ends_with(host, '.{s.host}')) AND starts_with(path, '{s.path}') THEN '{s.host}{s.path}'"
    for s in sorted(SITE_RULES, key=lambda s: -len(s.host + s.path))
)
_VERDICTS = " ".join(f"WHEN '{s.host}{s.path}' THEN '{s.verdict}'" for s in SITE_RULES)
_PATTERNS = " ".join(f"WHEN regexp_matches(url, '{p.pattern}', 'i') THEN '{p.pattern}'" for p in PATTERN_RULES)
OP8_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS h,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT *, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM p),
r AS (SELECT *, CASE {_FITS} END AS rule FROM l),
m AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {_PATTERNS} END END AS pattern FROM r)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN CASE rule {_VERDICTS} END WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM m
"""
