"""URL filters: rules indexed by their rarest literal token.

A rule is a host with a path prefix, or a pattern with ``*`` wildcards. Every rule becomes a
regular expression over ``host + path`` and a set of literal tokens that any URL it fits
must contain whole. How many URLs hold each of these tokens is counted over the whole
table; the index files a rule under its rarest token. A URL then fetches the rules of its
own tokens, and only those run their regular expressions; rules without a token are tried
on every URL. The rules are parameters of the job, ``MAX_RULES`` at most, and travel with it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import by_slices

MAX_RULES = 100_000
# A token is a run of these; hosts are lower case, paths as they are.
_TOKEN = re.compile(r"[A-Za-z0-9%]+")
_TOKENS = "[A-Za-z0-9%]+"
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``host`` and ``path``: the host with all its subdomains, paths that start so. ``pattern``
    instead: a text anywhere in host + path, ``*`` standing for any characters."""

    action: str
    host: str = ""
    path: str = ""
    pattern: str | None = None

    @property
    def name(self) -> str:
        return self.host + self.path if self.pattern is None else self.pattern

    def regex(self) -> str:
        if self.pattern is None:
            return rf"(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path or '')}" if self.path else rf"(?:[^/]*\.)?{re.escape(self.host)}(?:/|\Z)"
        return ".*".join(map(re.escape, self.pattern.split("*")))

    def tokens(self) -> list[str]:
        """Tokens that cannot be part of a longer one in a URL the rule fits."""
        if self.pattern is None:
            # The host begins after a dot or at the start, and ends before the path.
            text, closed_left, closed_right = self.host + (self.path or "/"), True, False
        else:
            text, closed_left, closed_right = self.pattern, False, False
        found = []
        for m in _TOKEN.finditer(text):
            left = text[m.start() - 1] if m.start() else ""
            right = text[m.end()] if m.end() < len(text) else ""
            if (left not in ("", "*") or (not left and closed_left)) and (right not in ("", "*") or (not right and closed_right)):
                found.append(m.group())
        return found


# The contract's host rules.
HOST_RULES = (
    Rule(ALLOW, "com", "/"), Rule(BLOCK, "example.com", "/en/"), Rule(ALLOW, "www.example.com", "/en/"),
    Rule(BLOCK, "net", "/es/"), Rule(BLOCK, "net", "/fr/"),
)
# Ours, for URLs no host rule fits: advertising, tracking and session addresses.
PATTERN_RULES = (
    Rule(BLOCK, pattern="/ads/"), Rule(BLOCK, pattern="/adserver/"), Rule(BLOCK, pattern=".doubleclick."),
    Rule(BLOCK, pattern="/tracker/*.gif"), Rule(BLOCK, pattern="/banner/*.swf"), Rule(BLOCK, pattern="/cgi-bin/*/login"),
    Rule(BLOCK, pattern="/wp-admin/"), Rule(BLOCK, pattern=";jsessionid="),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def token_counts(places: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """In how many URLs (columns host, path) each of the rules' tokens occurs."""
    known = places.sparkSession.createDataFrame([(t,) for t in sorted(set(tokens))], "token string")
    found = places.select(F.explode(F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(_TOKENS), F.lit(0)))).alias("token"))
    counted = found.join(F.broadcast(known), "token").groupBy("token").count()
    return {r["token"]: r["count"] for r in counted.collect()}  # one per rule token at most


class Index:
    """Rules by their rarest token; ``judge`` finds the longest that fits."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]) -> None:
        self.rules = list(rules)
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.compiled: dict[int, re.Pattern] = {}
        for i, rule in enumerate(self.rules):
            tokens = rule.tokens()
            if tokens:
                rarest = min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
                self.by_token.setdefault(rarest, []).append(i)
            else:
                self.always.append(i)

    def candidates(self, place: str) -> list[int]:
        found = list(self.always)
        for token in set(_TOKEN.findall(place)):
            found += self.by_token.get(token, ())
        return found

    def fits(self, i: int, host: str, path: str) -> bool:
        rule = self.rules[i]
        regex = self.compiled.get(i)
        if regex is None:
            regex = self.compiled[i] = re.compile(rule.regex(), re.S)
        if rule.pattern is None:
            return bool(host) and regex.match(host + path) is not None
        return regex.search(host + path) is not None

    def judge(self, host: str, path: str) -> Rule | None:
        """The longest fitting host rule, else the longest fitting pattern; first of equals."""
        fitting = [i for i in self.candidates(host + path) if self.fits(i, host, path)]
        if not fitting:
            return None
        return self.rules[min(fitting, key=lambda i: (self.rules[i].pattern is not None, -len(self.rules[i].name), i))]


def judge(pages: DataFrame, rules: Sequence[Rule] = (*HOST_RULES, *PATTERN_RULES), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule, pattern and verdict of every row.

    ``rule`` is the host rule that decides, ``pattern`` the pattern rule where no host rule fits;
    without either the verdict is ``allow``. A null URL or one without ``://`` has an empty host
    and path, which no host rule fits. Long URLs are read whole; of rules of one length the
    first wins; repeated rows are repeated, null ids stay, an empty table gives none; other
    columns are left behind.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    kind = pages.schema[id_col].dataType.simpleString()
    url = F.col(url_col).cast("string")
    places = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    counts = token_counts(places.select("host", "path"), [t for r in rules for t in r.tokens()])

    def run(batches):
        index = Index(rules, counts)

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [index.judge(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            hosts = [r.name if r and r.pattern is None else None for r in found]
            patterns = [r.name if r and r.pattern is not None else None for r in found]
            verdicts = [r.action if r else ALLOW for r in found]
            arrays = [*batch.columns, *(pa.array(x, pa.string()) for x in (hosts, patterns, verdicts))]
            return pa.RecordBatch.from_arrays(arrays, ["id", "host", "path", "rule", "pattern", "verdict"])

        yield from by_slices(convert, "url")(batches)

    judged = places.mapInArrow(run, f"id {kind}, host string, path string, rule string, pattern string, verdict string")
    return judged.withColumnRenamed("id", id_col)
