"""URL filter: host/path rules first, then a weighted vocabulary found by Aho-Corasick.

Terms count only where neither neighbour is an ASCII letter or digit.  One strict
term rejects a url; soft terms reject it when at least ``min_soft`` distinct ones
occur and their weights reach ``min_weight``.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

# Rules as (verdict, host, path prefix), strict terms, soft terms with weights.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
STRICT_TERMS = ("adult", "casino", "hentai", "malware", "phishing", "porn", "viagra", "warez", "xxx")
SOFT_TERMS = {
    "ads": 1, "bet": 1, "bets": 1, "cheap": 1, "clickbait": 1, "deals": 1, "farm": 1, "free": 1,
    "gambling": 2, "loan": 1, "pharma": 1, "pills": 2, "replica": 1, "spam": 2, "track": 1, "win": 1,
}


def host_of(url: Column) -> Column:
    """Lower-cased text after the first :// up to / ? # or the end; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end, unchanged."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules=RULES) -> Column:
    """Struct(rule, verdict) of the longest rule that fits, or null."""
    found = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[tuple[str, int], ...]):
    automaton = ahocorasick.Automaton()
    for term in strict:
        automaton.add_word(term, (term, 0))
    for term, weight in soft:
        automaton.add_word(term, (term, weight))
    automaton.make_automaton()
    return automaton


def _edge(text: str, at: int) -> bool:
    return not (0 <= at < len(text)) or not (text[at].isascii() and text[at].isalnum())


def term_hits(strict=STRICT_TERMS, soft=None):
    """pandas UDF: url -> struct(n_strict, n_soft, soft_weight) of distinct bounded terms."""
    soft = SOFT_TERMS if soft is None else soft
    key = tuple(sorted(strict)), tuple(sorted(soft.items()))
    lower = {c: c + 32 for c in range(65, 91)}

    @F.pandas_udf("n_strict int, n_soft int, soft_weight int")
    def hits(urls: pd.Series) -> pd.DataFrame:
        automaton, rows = _automaton(*key), []
        for url in urls:
            found = {}
            if url:
                url = url.translate(lower)
                for end, (term, weight) in automaton.iter(url):
                    if _edge(url, end - len(term)) and _edge(url, end + 1):
                        found[term] = weight
            soft_only = [w for w in found.values() if w]
            rows.append((len(found) - len(soft_only), len(soft_only), sum(soft_only)))
        return pd.DataFrame(rows, columns=["n_strict", "n_soft", "soft_weight"])

    return hits


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, strict=STRICT_TERMS, soft=None, min_soft: int = 2, min_weight: int = 2) -> DataFrame:
    """Add host, path, rule, n_strict, n_soft, soft_weight and verdict to every row.

    A null url, or one without ://, has an empty host and path and no rule; the
    vocabulary still judges what text there is.  Columns of these names in the
    input are replaced; all others stay.  No shuffle: one pass over the rows.
    """
    out = ["host", "path", "rule", "n_strict", "n_soft", "soft_weight", "verdict"]
    source = pages.drop(*[c for c in out if c != url])
    hits = source.select(F.struct("*").alias("row"), term_hits(strict, soft)(F.col(url)).alias("hits"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hits = hits.withColumn("found", match_rules(F.col("host"), F.col("path"), rules))
    rejected = (F.col("hits.n_strict") > 0) | ((F.col("hits.n_soft") >= min_soft) & (F.col("hits.soft_weight") >= min_weight))
    verdict = F.coalesce(F.col("found.verdict"), F.when(rejected, "block").otherwise("allow"))
    return hits.select("row.*", "host", "path", "found.rule", "hits.n_strict", "hits.n_soft", "hits.soft_weight", verdict.alias("verdict"))
