import random
import re

import pytest

from tabwright.llm.url_filter import BASE_RULES, TokenIndex, UrlRule, default_rules, filter_urls, op13_url_filter

BASE = [(h + p, v, h, p) for v, h, p in BASE_RULES]


def brute(url, rules=None, default="allow"):
    """Every rule's expression over the URL."""
    after = url.partition("://")[2] if url and "://" in url else ""
    host = re.match("[^/?#]*", after)[0]
    rest, path = after[len(host) :], re.match("[^?#]*", after[len(host) :])[0]
    low = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    host = low(host)
    fitting = [(len(r), r, v) for r, v, h, p in BASE if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fitting:
        return host, path, max(fitting)[1], max(fitting)[2], None
    own = sorted((-len(r.name), r.verdict, r.name) for r in (rules or default_rules()) if not r.of_host_kind and re.search(r.regex, host + low(rest)))
    return (host, path, None, own[0][1], own[0][2]) if own else (host, path, None, default, None)


URLS = [
    None, "", "no scheme", "://", "http://", "http://com/", "http://COM/", "http://a.com", "http://a.com?x=/", "http://a.com#/en/", "http://Example.Com/en/x", "https://www.example.com/en/1?p=2#top", "https://xexample.com/en/", "https://m.www.example.com/en/",
    "https://example.com/EN/", "https://a.example.net/es/", "http://net/fr/", "http://net/fr", "http://x.net:80/fr/", "http://free-bets.org/", "http://xfree-bets.org/", "http://m.free-bets.net/de/4", "http://a.org/login", "http://a.org/LOGIN?x", "http://a.org/logins",
    "http://a.org/wp-login.php", "http://a.org/calendar/2020/month/", "http://a.org/x?sessionid=3", "http://a.org/x?a=1&PHPSESSID=3", "http://docs.a.org/ads/", "http://x.gov/ads/", "http://x.gov", "http://gov.org/", "http://a.org/robots.txt", "http://a.org/robots.txt?x", "http://a.org/café/ads/",
    "http://a.org/\nads/\n", "a://b://c.com/", "http://İ.com/é", "http://a.org/" + "x/" * 20000 + "ads/", "http://a.com/en/", "http://www.example.com/en/", "http://www.example.com/en/",
]


def test_awkward(spark):
    rows = [(None if k % 9 == 0 else k, u, "x", "y") for k, u in enumerate(URLS)]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rest string").repartition(3)).collect()
    want = [(i, *brute(u)) for i, u, *_ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()
    got = op13_url_filter(spark, sf_dir)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, *brute(u))) for i, u in rows)
    assert {r.rule for r in got.select("rule").distinct().collect()} > {"com/", None}


@pytest.mark.parametrize("seed", range(3))
def test_index_loses_no_rule(seed):
    """Made rules and URLs of few letters: the tokens fetch every rule whose expression matches."""
    rng = random.Random(seed)
    bit = lambda k: "".join(rng.choice("ab./-?^*") for _ in range(rng.randrange(1, k)))
    patterns = {rng.choice(["", "|", "||"]) + bit(6) + rng.choice(["", "", "|"]) for _ in range(200)}
    rules = [UrlRule.of_pattern(rng.choice(["allow", "block"]), p) for p in sorted(patterns)]
    index = TokenIndex(rules, {"a": rng.randrange(5), "b": rng.randrange(5), "ab": 1})
    for _ in range(500):
        host, rest = "".join(rng.choice("ab.-") for _ in range(rng.randrange(5))), rng.choice(["", "/", "?"]) + bit(7)
        rest = rest if rest[0] in "/?#" else "/" + rest
        matching = [r for r in index.rules if re.search(r.regex, host + rest)]
        assert index.judge(host, rest)[1] == (matching[0] if matching else None)


def test_only_candidates_run():
    rules = [UrlRule.of_pattern("block", f"/word{k}/common/") for k in range(1000)] + [UrlRule.of_pattern("block", "*common")]
    index = TokenIndex(rules, {"common": 10**6})
    assert [index.rules[k].name for k in index.candidates("a.org/word7/common/")] == ["/word7/common/", "*common"]
    assert len(index.candidates("a.org/common/")) == 1
    assert set(index.always) == {k for k, r in enumerate(index.rules) if not r.tokens}


def test_refusals(spark):
    for wrong in (lambda: UrlRule.of_host("allow", "a.com", "x"), lambda: UrlRule.of_host("allow", "a.com", "/?x"), lambda: UrlRule.of_pattern("maybe", "/x/")):
        with pytest.raises(ValueError):
            wrong()
