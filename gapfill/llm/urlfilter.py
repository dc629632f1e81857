"""URL filters: host and path rules, then a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: terms of the default vocabulary; one strict hit rejects, soft weights add up over distinct terms
STRICT = ("adult", "casino", "escort", "hentai", "porn", "spam", "viagra", "xxx")
SOFT = {"bet": 1.0, "bets": 1.0, "bonus": 1.0, "cheap": 1.0, "farm": 1.0, "free": 1.0, "jackpot": 1.0, "loan": 1.0, "nude": 1.5,
        "pills": 1.0, "poker": 1.5, "prize": 1.0, "sex": 1.5, "slots": 1.0, "win": 1.0, "winner": 1.0}
SOFT_LIMIT = 2.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://`` up to ``/ ? #``, A-Z lower-cased, then up to ``? #``; both empty without it."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule ``(verdict, host, path)`` that fits the host or a parent domain and starts the path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def vocabulary_hits(url: Column, strict: Sequence[str] = STRICT, soft: Mapping[str, float] = SOFT) -> Column:
    """struct(n_strict, n_soft, weight): distinct terms that stand in the A-Z lower-cased URL between bytes other than a-z, 0-9."""
    terms = {t: None for t in strict} | {t: float(w) for t, w in soft.items() if t not in strict}

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick
        tree = ahocorasick.Automaton()
        for t in terms:
            tree.add_word(t, t)
        tree.make_automaton()
        low = str.maketrans(UPPER, LOWER)
        word = frozenset(LOWER + "0123456789")
        for urls in batches:
            rows = []
            for u in urls:
                u = "" if u is None else u.translate(low)
                found = {t for end, t in tree.iter(u)
                         if (end + 1 == len(u) or u[end + 1] not in word) and (end < len(t) or u[end - len(t)] not in word)}
                weights = [terms[t] for t in found if terms[t] is not None]
                rows.append((len(found) - len(weights), len(weights), float(sum(weights))))
            yield pd.DataFrame(rows, columns=["n_strict", "n_soft", "weight"])
    # the iterator form builds the automaton once per task
    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(count, "n_strict int, n_soft int, weight double")(url)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = (), strict: Sequence[str] = STRICT,
                soft: Mapping[str, float] = SOFT, soft_limit: float = SOFT_LIMIT, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft, weight): one row per page, its rule's verdict or the vocabulary's.

    The vocabulary blocks a URL with one strict term or distinct soft terms whose weights reach ``soft_limit``. Only ids and
    URLs are read; nothing is shuffled.

    Defined results: a null URL, or one without ``://``, has empty host and path and no rule; a null URL is allowed. Equal
    longest rules are settled by their text. Repeated rows get a row each.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "hits": vocabulary_hits(F.col("url"), strict, soft)})
    own = F.when((F.col("hits.n_strict") > 0) | (F.col("hits.weight") >= soft_limit), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "hits.n_strict", "hits.n_soft", "hits.weight")
