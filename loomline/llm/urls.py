"""URL filters: pattern rules found by their rarest literal token.

Each rule is a regular expression over host and path, with the literal tokens
(runs of a-z and 0-9, bounded on both sides) that every URL it fits must hold.
The rule is filed under the one of its tokens that the fewest URLs of the
corpus hold; a URL's tokens fetch the rules filed under them, and only those
rules' expressions run. Rules without a bounded literal are filed under the
empty token, which every URL fetches.

Native: DataFrame functions only. Pages aren't shuffled: a row looks its tokens up in
the rules, which are one value (a scalar subquery) of buckets by the token's hash, so
that a hot URL is no hot key. Only counts of the rules' tokens move, pre-aggregated. Rules
are a parameter of any number; an executor holds them once, in some hundred bytes each.

Defined results: every row stays, repeated ones too. A null URL and one without ``://``
have empty host and path, which no rule with a token fits. Equally ranked rules that
both fit decide by the smallest name, then verdict. An empty table stays empty. Other
columns of any name pass through; long URLs are matched whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import masked, unmasked

TOKEN_GAP = "[^a-z0-9]+"
#: Rules' tokens of so many bytes together are broadcast to the URLs' tokens before these are counted; more are joined with their counts.
BROADCAST_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A rule over host + path. name: as reported; null for rules that only give a verdict. rank: of the rules that fit a URL, that of the highest rank decides, then the smallest name and verdict."""

    pattern: str
    verdict: str
    rank: int
    name: str | None = None
    tokens: tuple[str, ...] = field(default=())


def host_rule(verdict: str, rule: str) -> Rule:
    """A rule like ``example.org/es/``: fits the host and its subdomains if the path starts with the rule's; longer ones win."""
    host, slash, rest = rule.partition("/")
    path = slash + rest
    pattern = rf"^(?:[^/?#]*\.)?{_quoted(host)}(?=\z|/){_quoted(path)}"
    whole = path.rpartition("/")[0]  # a last part that isn't ended may go on in a URL
    tokens = tuple(t for t in re.split(TOKEN_GAP, f"{host}/{whole}".lower()) if t)
    return Rule(pattern, verdict, 1_000_000 + len(rule), rule, tokens)


def pattern_rule(verdict: str, pattern: str, *tokens: str) -> Rule:
    """A rule by a regular expression over host and path and the literal tokens that each match needs."""
    return Rule(pattern, verdict, 0, None, tokens)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/])", r"\\\1", text)


#: The rules that decide first.
HOST_RULES = (
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
)

#: For pages that no host rule decides: hosts and paths that offer no prose. Each needs its words as whole tokens.
PATTERN_RULES = (
    pattern_rule("block", r"(?:^|[.-])spam(?:[.-]|\z|/)", "spam"),
    pattern_rule("block", r"(?:^|[.-])casino(?:[.-]|\z|/)", "casino"),
    pattern_rule("block", r"(?:^|[.-])porn(?:[.-]|\z|/)", "porn"),
    pattern_rule("block", r"(?:^|[.-])(?:ads?)(?:[.-]|\z|/)[^/]*/(?:.*[/._-])?click(?:[/._-]|\z)", "click"),
    pattern_rule("block", r"^(?:ads?|adserver|tracker|tracking)\.[^/]*/pixel(?:[/._-]|\z)", "pixel"),
    pattern_rule("block", r"/wp-login\.php\z", "wp", "login", "php"),
    pattern_rule("block", r"/cart/(?:add|checkout)(?:/|\z)", "cart"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


_RULE = "_id int, _pattern string, _verdict string, _order long, _name string, _tokens array<string>"


def _tokens(at: Column) -> Column:
    """The tokens of a host and path, and the empty one."""
    return F.array_distinct(F.split(F.concat_ws("/", F.lit(""), F.lower(at), F.lit("")), TOKEN_GAP))


def _index(held: DataFrame, rules: tuple[Rule, ...]) -> Column:
    """The rules in buckets by the hash of their rarest token among the URLs (_at)."""
    spark = held.sparkSession
    told = [(i, r.pattern, r.verdict, -r.rank, r.name, list(r.tokens or ("",))) for i, r in enumerate(rules)]
    table = spark.createDataFrame(told, _RULE)
    needed = table.select("_id", F.explode("_tokens").alias("_token"))
    tokens = held.select(F.explode(_tokens(F.col("_at"))).alias("_token"))
    own = {t for r in rules for t in r.tokens or ("",)}
    listed = spark.createDataFrame([(t,) for t in sorted(own)], "_token string")
    if sum(map(len, own)) <= BROADCAST_BYTES:
        counts = tokens.join(F.broadcast(listed), "_token", "left_semi").groupBy("_token").agg(F.count("*").alias("_n"))
    else:
        counts = tokens.groupBy("_token").agg(F.count("*").alias("_n")).join(listed, "_token", "left_semi")
    rarest = needed.join(counts, "_token", "left").groupBy("_id").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_token")).alias("_rarest"))
    rule = F.struct(F.col("_rarest._token").alias("token"), F.col("_pattern").alias("pattern"), F.struct("_order", "_name", "_verdict").alias("told"))
    filed = table.join(rarest, "_id").select(F.pmod(F.xxhash64("_rarest._token"), F.lit(len(rules))).cast("int").alias("_bucket"), rule.alias("_rule"))
    buckets = filed.groupBy("_bucket").agg(F.collect_list("_rule").alias("_rules"))
    every = spark.range(len(rules)).select(F.col("id").cast("int").alias("_bucket")).join(buckets, "_bucket", "left")
    whole = F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_rules"))), lambda x: x["_rules"])
    return every.agg(whole.alias("_index")).scalar()


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict of each URL (existing columns of these names are replaced)."""
    pages, names = masked(pages)
    at = F.col(names[url])
    told = pages.withColumn("host", host_of(at)).withColumn("path", path_of(at)).withColumn("_at", F.concat("host", "path"))
    if rules:
        held = told.where(at.isNotNull()).select("_at")
        found = F.flatten(F.transform(_tokens(F.col("_at")), lambda t: F.filter(F.coalesce(F.get(F.col("_index"), F.pmod(F.xxhash64(t), F.lit(len(rules))).cast("int")), F.array()), lambda r: r["token"] == t)))
        fits = F.transform(F.filter(found, lambda r: F.rlike(F.col("_at"), r["pattern"])), lambda r: r["told"])
        told = told.withColumn("_index", _index(held, rules)).withColumn("_best", F.when(at.isNotNull(), F.array_min(fits)))
        rule, verdict = F.col("_best._name"), F.col("_best._verdict")
    else:
        rule = verdict = F.lit(None).cast("string")
    return told.select(*unmasked(names, ["host", "path", "rule", "verdict"]), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.lit(otherwise)).alias("verdict"))


#: The same rows by testing every rule on every URL.
SQL = r"""
with p as (
  select page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
r(rule, rhost, rpath, verdict) as (values
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
j as (
  select p.*, (select arg_max({'rule': rule, 'verdict': verdict}, length(rule)) from r
    where (p.host = rhost or ends_with(p.host, '.' || rhost)) and starts_with(p.path, rpath)) as best
  from p)
select page_id, host, path, best.rule as rule,
  case when best is not null then best.verdict
    when regexp_matches(host || path, '(?:^|[.-])(?:spam|casino|porn)(?:[.-]|\z|/)')
      or regexp_matches(host || path, '(?:^|[.-])(?:ads?)(?:[.-]|\z|/)[^/]*/(?:.*[/._-])?click(?:[/._-]|\z)')
      or regexp_matches(host || path, '^(?:ads?|adserver|tracker|tracking)\.[^/]*/pixel(?:[/._-]|\z)')
      or regexp_matches(host || path, '/wp-login\.php\z')
      or regexp_matches(host || path, '/cart/(?:add|checkout)(?:/|\z)') then 'block'
    else 'allow' end as verdict
from j
"""
