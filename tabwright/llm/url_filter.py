"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression that can only match where certain whole tokens (runs of 0-9, a-z) stand in the URL. One
aggregate counts how many URLs hold each of the rules' tokens; a rule is then filed under the token that the fewest hold.
The tokens of a URL fetch the rules filed under them, and only these, beside rules without a token, run their expression.

Two kinds of rules: ``UrlRule.of_host`` (a host with all its subdomains, and the beginning of a path) and
``UrlRule.of_pattern``, in the notation of blocking lists: ``||`` a host or a subdomain of it begins here, ``|`` begin or
end, ``^`` a character that isn't of 0-9, A-Z, a-z, ``_.%-``, or the end, ``*`` anything. Rules of hosts come first,
then those of patterns; within a kind the longest wins, of equal ones allow, then the first by name. Without any the
verdict is ``default``.

Rules are a parameter that every task holds: at most ``MOST_RULES``, more are refused. Nothing is shuffled but the counts
of the rules' tokens, combined before, so no key is hot. Defined results: null, or a URL without ``://``, has empty host
and path and fits no rule; A to Z of the host are lower-cased, the path is compared as it is, patterns see everything in
lower case; URLs of any length are matched whole; each row is judged by itself, so repeated rows and null ids do no
harm; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import map_batches, table

MOST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = str.maketrans(UPPER, LOWER)
TOKEN = re.compile("[0-9a-z]+")
BEGIN_OF_HOST, SEPARATOR = r"^(?:[^/?#]*\.)?", r"(?:[^0-9A-Za-z_.%-]|\Z)"
SCHEMA = "page_id long, host string, path string, rule string, verdict string, method_rule string"

#: Fixed rules of the contract: verdict, host, path.
BASE_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: The method's own: sites and pages that give no text to learn from, and sites that do.
BLOCKED = [
    "||free-bets.", "||cheap-pills.", "||casino.", "||online-casino.", "||poker.", "||sports-betting.", "||lottery.", "||payday-loans.", "||win-prizes.", "||replica-watches.",
    "||adult.", "||escort.", "||porn.", "||xxx^", "||ads.", "||adserver.", "||banner.", "||click.", "||tracker.", "||tracking.",
    "/ads/", "/adclick^", "/affiliate/", "/banners/", "/casino/", "/popup/", "/porn/", "/viagra^", "/bonus-codes/", "/buy-now^",
    "/account/", "/cart/", "/checkout/", "/login^", "/logout^", "/register^", "/signin^", "/signup^", "/wp-login.php^", "/wp-admin/",
    "/cgi-bin/", "/feed/", "/rss^", "/print/", "/search?", "/share?", "/tag/", "/calendar/*/month/", "?sessionid=", "&sessionid=", "?phpsessid=", "&phpsessid=", "?replytocom=", "&replytocom=",
]
ALLOWED = ["||ac.uk^", "||archive.org^", "||edu^", "||gov^", "||gutenberg.org^", "||wikipedia.org^", "||wikisource.org^", "/license^", "/licence^", "||docs.", "/robots.txt|"]


def bounded_tokens(literal: str, begins: bool, ends: bool) -> set[str]:
    """The tokens of a literal that stand whole in whatever it matches: none at an edge beside which more of a token may stand."""
    return {m[0] for m in TOKEN.finditer(literal.translate(LOWERED)) if (m.start() or begins) and (m.end() < len(literal) or ends)}


@dataclass(frozen=True)
class UrlRule:
    name: str
    verdict: str
    regex: str
    tokens: frozenset[str]
    of_host_kind: bool

    def __post_init__(self) -> None:
        if self.verdict not in ("allow", "block"):
            raise ValueError(f"{self.name}: verdict {self.verdict!r} is neither allow nor block")

    @classmethod
    def of_host(cls, verdict: str, host: str, path: str) -> UrlRule:
        if re.search("[?#]", path) or not path.startswith("/") or not host or re.search("[/?#]", host):
            raise ValueError(f"{host}{path}: a rule needs a host and a path from its /, without query")
        host = host.translate(LOWERED)
        return cls(host + path, verdict, f"{BEGIN_OF_HOST}{re.escape(host)}{re.escape(path)}", frozenset(bounded_tokens(host, True, True) | bounded_tokens(path, True, False)), True)

    @classmethod
    def of_pattern(cls, verdict: str, pattern: str) -> UrlRule:
        rest, made = pattern.translate(LOWERED), ""
        at_host, at_begin = rest.startswith("||"), rest.startswith("|")
        rest = rest.lstrip("|") if at_begin else rest
        at_end = rest.endswith("|")
        parts = re.split(r"([*^])", rest.removesuffix("|"))
        tokens: set[str] = set()
        for k, part in enumerate(parts):
            if part == "*":
                made += r"[\s\S]*"
            elif part == "^":
                made += SEPARATOR
            else:
                made += re.escape(part)
                begins = parts[k - 1] == "^" if k else at_begin
                tokens |= bounded_tokens(part, begins, parts[k + 1] == "^" if k + 1 < len(parts) else at_end)
        return cls(pattern, verdict, (BEGIN_OF_HOST if at_host else "^" if at_begin else "") + made + (r"\Z" if at_end else ""), frozenset(tokens), False)


def default_rules() -> list[UrlRule]:
    own = [UrlRule.of_pattern("block", p) for p in BLOCKED] + [UrlRule.of_pattern("allow", p) for p in ALLOWED]
    return [UrlRule.of_host(*r) for r in BASE_RULES] + own


class TokenIndex:
    """Rules by the token that the fewest URLs hold."""

    def __init__(self, rules: Iterable[UrlRule], counts: Mapping[str, int]) -> None:
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        # The first that fits is the answer of its kind.
        self.rules = sorted(rules, key=lambda r: (not r.of_host_kind, -len(r.name), r.verdict, r.name))
        self.regexes = [re.compile(r.regex) for r in self.rules]
        for k, r in enumerate(self.rules):
            rarest = min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=None)
            (self.always if rarest is None else self.by_token.setdefault(rarest, [])).append(k)

    def candidates(self, lowered: str) -> list[int]:
        """The rules that the tokens of a URL fetch, in their order, and those without a token."""
        found = [k for t in set(TOKEN.findall(lowered)) for k in self.by_token.get(t, ())]
        return sorted([*self.always, *found])

    def judge(self, host: str, rest: str) -> tuple[UrlRule | None, UrlRule | None]:
        """The rule of a host, and the pattern, that decide about a URL without its scheme."""
        lowered = host + rest.translate(LOWERED)
        of_host = of_pattern = None
        for k in self.candidates(lowered):
            r = self.rules[k]
            if r.of_host_kind:
                of_host = of_host or (r if self.regexes[k].search(host + rest) else None)
            elif of_host is not None:
                break
            elif self.regexes[k].search(lowered):
                of_pattern = r
                break
        return of_host, of_pattern


def parts_of(url: Column) -> tuple[Column, Column, Column]:
    """Host in lower case, path, and all that follows the host."""
    url = F.when(F.instr(url, "://") > 0, url).otherwise("")
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    rest = F.substring(after, F.length(host) + 1, F.length(after))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "^[^?#]*", 0), rest


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many of the URLs (host, rest) hold each of the rules' tokens."""
    if not tokens:
        return {}
    found = F.regexp_extract_all(F.concat("host", F.translate("rest", UPPER, LOWER)), F.lit("[0-9a-z]+"), F.lit(0))
    held = urls.select(F.explode(F.array_distinct(found)).alias("token")).where(F.col("token").isin(sorted(tokens)))
    return {r.token: r["count"] for r in held.groupBy("token").count().collect()}  # at most a row for each token of the rules


def filter_urls(pages: DataFrame, rules: Iterable[UrlRule] | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, the rule of a host that decides, the verdict, and the pattern that decides where no such rule does."""
    rules = default_rules() if rules is None else list(rules)
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules are more than {MOST_RULES}, which a task may hold")
    if default not in ("allow", "block"):
        raise ValueError(f"default {default!r} is neither allow nor block")
    host, path, rest = parts_of(F.col(f"`{url_col}`"))
    urls = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(rest, F.lit("")).alias("rest"))
    counts = token_counts(urls, {t for r in rules for t in r.tokens})
    held: list[TokenIndex] = []

    def judge(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        index = held[0] if held else TokenIndex(rules, counts)
        held[:] = [index]
        found = [index.judge(h, r) for h, r in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        said = [[f[0].name if f[0] else None for f in found], [(f[0] or f[1]).verdict if f[0] or f[1] else default for f in found], [f[1].name if f[1] else None for f in found]]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(s, pa.string()) for s in said)], names=["page_id", "host", "path", "rule", "verdict", "method_rule"])

    return map_batches(urls, judge, SCHEMA)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    hosts = ", ".join(f"({quoted(h + p)}, {quoted(v)}, {quoted(h)}, {quoted(p)})" for v, h, p in BASE_RULES)
    own = ", ".join(f"({quoted(r.name)}, '{r.verdict}', {quoted(r.regex.replace(chr(92) + 'Z', '$'))})" for r in default_rules() if not r.of_host_kind)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after FROM pages),
h AS (SELECT page_id, regexp_extract(after, '^[^/?#]*') AS host, after FROM u),
p AS (SELECT row_number() OVER () AS i, page_id, translate(host, '{UPPER}', '{LOWER}') AS host, substr(after, length(host) + 1) AS rest, regexp_extract(substr(after, length(host) + 1), '^[^?#]*') AS path FROM h),
base(rule, verdict, rule_host, rule_path) AS (VALUES {hosts}),
own(rule, verdict, pattern) AS (VALUES {own}),
b AS (SELECT i, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN base ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY i),
o AS (
  SELECT i, first(rule ORDER BY length(rule) DESC, verdict, rule) AS rule, first(verdict ORDER BY length(rule) DESC, verdict, rule) AS verdict
  FROM p JOIN own ON regexp_matches(host || translate(rest, '{UPPER}', '{LOWER}'), pattern) WHERE i NOT IN (SELECT i FROM b) GROUP BY i
)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, o.verdict, 'allow') AS verdict, o.rule AS method_rule
FROM p LEFT JOIN b USING (i) LEFT JOIN o USING (i)
"""


OP13_SQL = _sql()
