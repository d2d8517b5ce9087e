"""Verdicts on URLs against a search term by term and rule by rule."""

import random
import re

import pytest

from tablegauge.llm import url_filter as uf
from tablegauge.llm.queries import URL_RULES, op12_url_filter


def brute(url, rules=URL_RULES, vocabulary=uf.VOCABULARY, reject_at=2):
    text = url or ""
    match = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", text)
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    host, path = (lower(match[2]), match[3]) if match else ("", "")
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, action = max(fits)[2:] if fits else (None, None)
    hits = [w for t, w in vocabulary.items() if re.search(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", lower(text))]
    verdict = action or ("block" if sum(hits) >= reject_at else "allow")
    strict = sum(w >= reject_at for w in hits)
    return host, path, rule, verdict, strict, len(hits) - strict, sum(hits)


URLS = [
    None, "", "nothing", "://", "http://", "https://A.Example.COM", "http://net/", "http://net", "http://a.net?x=/en/", "http://sub.example.net/en/",
    "http://example.net/EN/1", "http://xexample.net/en/1", "http://myexample.com/de/", "http://a.b.example.com/de/x?casino", "http://k.org/fr/casino/xxx",
    "http://casino.example.com/", "http://casinos-x.com", "http://mycasino.com/", "http://free.x.com/free/bets", "http://a.com/free/free-FREE", "http://a.com/#cheap?pills",
    "http://adult-x.example.com/en/1", "http://adult-xy.example.com/", "http://x.com/poker1/sex", "http://é.com/ésex/nude", "a://b://c/d", "ftp://u:p@h.net:80/en/",
    "http://x.com/" + "a" * 200_000 + "/casino", "http://a.com/\nline/x?q#f",
]


def test_query(spark, tmp_path):
    rng = random.Random(2)
    words = ["en/", "de/", "fr/", "casino", "free", "bets", "a", "-", "/", ".", "?", "#", "net", "example.com", "org", "://", "XXX", "sex"]
    urls = URLS + URLS[10:14] + ["http://" + "".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "<p>", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, verdict int")
    pages.repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: tuple(r)[1:] for r in op12_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert len({v[3] for v in got.values()}) == 2 and len({v[2] for v in got.values()}) == 5


def test_rules_of_one_length_and_own_vocabulary(spark):
    rules = [("block", "b.com", "/aa"), ("allow", "a.b.com", "/"), ("block", "b.com", "/aa"), ("allow", "c.b.com", "")]
    vocabulary = {"One": 3, "two two": 1, "<x>": 2}
    urls = ["http://a.b.com/aa", "http://b.com/aab", "http://c.b.com/aa", "s://one", "s://ONE two two", "s:// two two", "s://<x>two two", "s://oneone"]
    pages = spark.createDataFrame([(u, 1) for u in urls], "url string, host int")
    got = {r.url: tuple(r)[1:] for r in uf.url_verdicts(pages, rules, vocabulary, reject_at=3).collect()}
    assert got == {u: brute(u, rules[:2] + rules[3:], {k.lower(): v for k, v in vocabulary.items()}, 3) for u in urls}


def test_odd_tables(spark):
    pages = spark.createDataFrame([("http://casino.com", "p")], "host string, `a.b` string")
    made = uf.url_verdicts(pages, url="host")
    assert made.columns[0] == "a.b" and made.first().verdict == "block" and made.first().host == "casino.com"
    assert uf.url_verdicts(pages.limit(0), url="host").collect() == []
    assert uf.url_verdicts(pages, url="host", vocabulary={}).first().verdict == "allow"
    with pytest.raises(ValueError, match="allows or blocks"):
        uf.url_verdicts(pages, [("drop", "a", "/")], url="host")
    with pytest.raises(ValueError, match="empty"):
        uf.url_verdicts(pages, vocabulary={"": 1}, url="host")
