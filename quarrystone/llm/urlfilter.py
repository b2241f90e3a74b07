"""URL filters: pattern rules indexed by their rarest literal token.

A URL's tokens fetch the candidate rules from the index; only those run their regular expressions.  Native
expressions only.  Up to MAP_RULES rules the index is a literal map and nothing is shuffled; a longer list is a table
that the tokens of the distinct URLs are joined to.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rules of a literal index, and of an index that is broadcast to the tokens.
MAP_RULES, BROADCAST_RULES = 2_000, 200_000


@dataclass(frozen=True)
class UrlRule:
    """``rule``: its name; ``verdict``: allow or block; ``regex`` runs on ``host + path``; ``rank``: longest wins.

    ``tokens`` are literal tokens that every URL it can fit has.  ``named`` rules are reported by name; the
    others are the method's own patterns, which decide only where no named rule fits.
    """

    rule: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    rank: int
    named: bool = True


def host_path_rule(verdict: str, rule: str) -> UrlRule:
    """A rule like ``example.com/en/7``: the host and all subdomains, paths that start with ``/en/7``."""
    host, _, path = rule.partition("/")
    whole = path.split("/")[:-1]  # a last piece may be the start of a longer one
    tokens = (*(x for x in re.findall(r"[^._-]+", host)), *(x for p in whole for x in re.findall(r"[^./_-]+", p)))
    return UrlRule(rule, verdict, r"^(?:[^/]*\.)?" + re.escape(host) + "/" + re.escape(path), tokens, len(rule))


def pattern_rule(verdict: str, name: str, regex: str, *tokens: str) -> UrlRule:
    return UrlRule(name, verdict, regex, tokens, len(regex), named=False)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased and nothing else; a text of one byte a character takes the faster way."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2147483647))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.concat(host, path), r"[./_-]+"))


def token_counts(urls: DataFrame, rules: list[UrlRule], url_col: str = "url") -> dict[str, int]:
    """How many URLs hold each literal token of the rules: one row per rule token comes to the driver."""
    known = sorted({t for r in rules for t in r.tokens})
    host, path = url_parts(F.col(url_col))
    if len(known) <= MAP_RULES:
        hit = urls.select(F.explode(F.array_intersect(url_tokens(host, path), F.array(*map(F.lit, known)))).alias("t"))
    else:
        wanted = urls.sparkSession.createDataFrame([(t,) for t in known], "t string")
        wanted = F.broadcast(wanted) if len(known) <= BROADCAST_RULES else wanted
        hit = urls.select(F.explode(url_tokens(host, path)).alias("t")).join(wanted, "t", "left_semi")
    return {r["t"]: r["n"] for r in hit.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}


def filter_urls(urls: DataFrame, rules: list[UrlRule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """All rows of ``urls`` plus host, path, rule and verdict.

    Among the fitting named rules the longest wins (ties: the name); its name is ``rule``.  Where none fits,
    ``rule`` is null and the longest fitting pattern decides, else ``default``.  A null or malformed url has empty
    host and path and gets ``default``; an url of any length is judged whole.  Repeated rows stay; an empty table
    stays empty.  Columns of the input called host, path, rule or verdict are replaced.  A rule without a literal
    token is an error.
    """
    if any(not r.tokens for r in rules):
        raise ValueError("each rule needs a literal token")
    seen = token_counts(urls, rules, url_col)
    index: dict[str, list[UrlRule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (seen.get(t, 0), -len(t), t)), []).append(r)
    host, path = url_parts(F.col(url_col))
    out = urls.withColumn("host", host).withColumn("path", path)
    out = _by_map(out, index) if len(rules) <= MAP_RULES else _by_join(out, index)
    return (
        out.withColumn("rule", F.when(F.col("__best.named"), F.col("__best.rule")))
        .withColumn("verdict", F.coalesce(F.col("__best.verdict"), F.lit(default)))
        .drop("__best")
    )


FIELDS = ["named", "rank", "rule", "verdict", "regex"]  # the largest struct wins: named before patterns, then the longest


def _by_map(urls: DataFrame, index: dict[str, list[UrlRule]]) -> DataFrame:
    """``urls`` plus ``__best``, the winning rule, inside the row."""
    if not index:
        return urls.withColumn("__best", F.lit(None).cast("struct<named: boolean, rank: int, rule: string, verdict: string, regex: string>"))

    def packed(r: UrlRule) -> Column:
        return F.struct(*[F.lit(getattr(r, f)).alias(f) for f in FIELDS])

    table = F.create_map(*[x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(packed, rs)))])
    tokens = F.array_intersect(url_tokens(F.col("host"), F.col("path")), F.map_keys(table))
    fetched = F.flatten(F.transform(tokens, lambda t: table[t]))
    full = F.concat("host", "path")
    return urls.withColumn("__best", F.array_max(F.filter(fetched, lambda r: F.regexp_like(full, r["regex"]))))


def _by_join(urls: DataFrame, index: dict[str, list[UrlRule]]) -> DataFrame:
    """The same from a table of rules: the tokens of each distinct (host, path) fetch their rules by a join."""
    rows = [(t, r.named, r.rank, r.rule, r.verdict, r.regex) for t, rs in index.items() for r in rs]
    table = urls.sparkSession.createDataFrame(rows, "t string, named boolean, rank int, rule string, verdict string, regex string")
    table = F.broadcast(table) if len(rows) <= BROADCAST_RULES else table
    whole = urls.select("host", "path").distinct()
    fetched = whole.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("t")).join(table, "t")
    fits = fetched.where(F.regexp_like(F.concat("host", "path"), F.col("regex")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(*FIELDS)).alias("__best"))
    return urls.join(best, ["host", "path"], "left")


#: The production rules: named host/path rules, then the method's own patterns.
RULES = [
    host_path_rule("block", "com/en/"), host_path_rule("allow", "example.com/en/7"), host_path_rule("allow", "net/de/"),
    host_path_rule("block", "example.net/de/8"), host_path_rule("block", "org/es/"),
]
#: Words that make a host or path piece unwanted, and path pieces of pages that hold no text of their own (fixed lists).
WORDS = "casino poker betting roulette jackpot viagra cialis porn xxx escort payday torrent warez keygen crack cracked nulled rapidshare"
PIECES = (
    "login logout signin signup register checkout cart basket wishlist account password-reset wp-login wp-admin admin xmlrpc cgi-bin search calendar"
    " print share tracker adserver banner affiliate redirect unsubscribe captcha sitemap"
)


def _tokens(word: str) -> list[str]:
    return re.findall(r"[^./_-]+", word)


RULES += [pattern_rule("block", f"word {w}", rf"(?:^|[./_-]){w}(?:[./_-]|$)", w) for w in WORDS.split()]
RULES += [pattern_rule("block", f"piece {p}", rf"/{re.escape(p)}/", *_tokens(p)) for p in PIECES.split()]
RULES += [pattern_rule("block", "feeds", r"/feed/rss(?:/|$)", "feed", "rss")]
