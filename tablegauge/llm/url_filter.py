"""Verdicts on URLs: rules by host and path first, then a weighted vocabulary found by Aho-Corasick.

One automaton over all terms reads a URL once. A hit counts where neither neighbour is a letter or digit,
so that a term inside a longer word is none. Each distinct term counts once, strict ones with a weight
that rejects alone, soft ones with a share of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms that reject alone, and terms of which two distinct ones reject.
STRICT_TERMS = (
    "adult-x", "camgirl", "camgirls", "casino", "casinos", "cialis", "escort-service", "gore", "hentai", "keygen", "malware", "milf",
    "phishing", "porn", "porno", "spam", "viagra", "warez", "x-rated", "xxx",
)
SOFT_TERMS = (
    "ads", "adult", "bet", "bets", "betting", "bonus", "cams", "cheap", "crack", "cracked", "dating", "erotic", "escort", "farm", "free",
    "gambling", "hookup", "jackpot", "loan", "loans", "lottery", "nude", "nudes", "payday", "pharmacy", "pill", "pills", "poker", "replica",
    "rx", "sex", "sexy", "slots", "torrent", "torrents", "track", "tracker", "tracking", "webcam", "win",
)
STRICT, SOFT, REJECT_AT = 2, 1, 2
VOCABULARY: Mapping[str, int] = {**dict.fromkeys(SOFT_TERMS, SOFT), **dict.fromkeys(STRICT_TERMS, STRICT)}

#: Terms and rules travel to every task; more than this many of either are refused.
MOST_ENTRIES = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = frozenset(LOWER + "0123456789")
_FOUND = pa.struct([("rule", pa.string()), ("verdict", pa.string()), ("strict_hits", pa.int32()), ("soft_hits", pa.int32()), ("weight", pa.int64())])
FOUND_TYPE = "struct<rule: string, verdict: string, strict_hits: int, soft_hits: int, weight: long>"

#: Action, host and path of a rule; it holds for the host and all its subdomains.
Rule = tuple[str, str, str]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, its letters A-Z in lower case, and path of a URL; both empty for null or where `://` is missing."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def automaton(vocabulary: Mapping[str, int]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for number, (term, weight) in enumerate(sorted(vocabulary.items())):
        built.add_word(term, (number, len(term), weight))
    built.make_automaton()
    return built


def term_hits(built: ahocorasick.Automaton, text: str) -> dict[int, int]:
    """Weight by number of the distinct terms in a lower-cased text that stand between non-word characters."""
    found: dict[int, int] = {}
    for last, (number, length, weight) in built.iter(text):
        if number in found:
            continue
        first = last - length + 1
        if (first == 0 or text[first - 1] not in _WORD) and (last + 1 == len(text) or text[last + 1] not in _WORD):
            found[number] = weight
    return found


def rule_index(rules: Iterable[Rule]) -> dict[str, list[tuple[str, str, str]]]:
    """Path, action and text of the rules by host; of equal rules the first counts."""
    by_host: dict[str, dict[str, str]] = {}
    for action, host, path in rules:
        if action not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks, not {action!r}")
        by_host.setdefault(host.lower(), {}).setdefault(path, action)
    return {host: [(path, action, host + path) for path, action in paths.items()] for host, paths in by_host.items()}


def fitting_rule(index: Mapping[str, list[tuple[str, str, str]]], host: str, path: str) -> tuple[str | None, str | None]:
    """Text and action of the longest rule (host and path) that fits; of two as long, the one with the longer host."""
    rule, action, longest = None, None, -1
    at = 0
    while at >= 0:  # the host, then each part after a dot
        suffix = host[at:]
        for start, what, text in index.get(suffix, ()):
            if len(text) > longest and path.startswith(start):
                rule, action, longest = text, what, len(text)
        dot = host.find(".", at)
        at = dot + 1 if dot >= 0 else -1
    return rule, action


def url_verdicts(
    pages: DataFrame, rules: Iterable[Rule] = (), vocabulary: Mapping[str, int] = VOCABULARY, url: str = "url", reject_at: int = REJECT_AT
) -> DataFrame:
    """`pages` with all rows and columns plus `host`, `path`, `rule`, `verdict`, `strict_hits`, `soft_hits`, `weight`.

    A rule that fits decides; else a URL is blocked if the weights of its distinct terms sum up to
    `reject_at`. Terms are found anywhere in the whole URL, letters A-Z in either case. A term of weight
    `reject_at` is strict. A null or empty URL has empty host and path, no hits, and is allowed. Rows are
    independent, so repeated ones get the same; columns of these names are replaced. `rules` and
    `vocabulary` are lists of the configuration, at most `MOST_ENTRIES` long, never made from the data.
    """
    index = rule_index(rules)
    terms = {t.translate(str.maketrans(UPPER, LOWER)): w for t, w in vocabulary.items()}
    if "" in terms or max(len(terms), sum(map(len, index.values()))) > MOST_ENTRIES:
        raise ValueError(f"terms must not be empty, and terms and rules at most {MOST_ENTRIES}")

    @F.arrow_udf(FOUND_TYPE)
    def judge(urls: pa.Array, hosts: pa.Array, paths: pa.Array) -> pa.Array:
        built = automaton(terms) if terms else None
        rows = []
        for text, host, path in zip(urls.to_pylist(), hosts.to_pylist(), paths.to_pylist(), strict=True):
            rule, action = fitting_rule(index, host, path)
            weights = term_hits(built, text).values() if built else ()
            total, strict = sum(weights), sum(w >= reject_at for w in weights)
            verdict = action or ("block" if total >= reject_at else "allow")
            rows.append({"rule": rule, "verdict": verdict, "strict_hits": strict, "soft_hits": len(weights) - strict, "weight": total})
        return pa.array(rows, _FOUND)

    made = ("host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight")
    names = [F.col(f"`{c}`") for c in pages.columns if c not in made]
    host, path = url_parts(F.col(f"`{url}`"))
    lowered = F.translate(F.coalesce(F.col(f"`{url}`"), F.lit("")), UPPER, LOWER)
    # the URL itself may be called like a new column, so parts are made under other names first
    parts = pages.select(*names, F.struct(lowered.alias("url"), host.alias("host"), path.alias("path")).alias("__parts"))
    found = parts.withColumn("__found", judge("__parts.url", "__parts.host", "__parts.path"))
    return found.select(*names, "__parts.host", "__parts.path", *[f"__found.{c}" for c in made[2:]])


def url_verdicts_sql(rules: Iterable[Rule], vocabulary: Mapping[str, int] = VOCABULARY, reject_at: int = REJECT_AT) -> str:
    """The same in SQL: each term as a pattern between non-word characters; plain ASCII terms without pattern characters."""
    terms = ", ".join(f"('{t}', {w})" for t, w in sorted(vocabulary.items()))
    listed = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in rules)
    lowered = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    return f"""
WITH parts AS (
    SELECT page_id, {lowered} AS lowered,
           translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
           regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
    FROM pages),
urls AS (SELECT DISTINCT lowered, host, path FROM parts),
terms(term, weight) AS (VALUES {terms}),
hits AS (
    SELECT lowered, CAST(sum(weight) AS BIGINT) AS weight,
           CAST(count(*) FILTER (weight >= {reject_at}) AS INT) AS strict_hits, CAST(count(*) FILTER (weight < {reject_at}) AS INT) AS soft_hits
    FROM (SELECT DISTINCT lowered FROM urls) JOIN terms ON regexp_matches(lowered, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')
    GROUP BY lowered),
rules(action, rule_host, rule_path) AS (VALUES {listed}),
fits AS (
    SELECT lowered, host, path, rule_host || rule_path AS rule, action
    FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    QUALIFY row_number() OVER (PARTITION BY lowered, host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) = 1)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.action, CASE WHEN h.weight >= {reject_at} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(h.strict_hits, 0) AS strict_hits, coalesce(h.soft_hits, 0) AS soft_hits, coalesce(h.weight, 0) AS weight
FROM parts p LEFT JOIN hits h ON p.lowered = h.lowered
LEFT JOIN fits f ON p.lowered = f.lowered AND p.host = f.host AND p.path = f.path
"""
