"""URL filter: host and path rules first, a weighted vocabulary for the rest.

Vocabulary: one Aho-Corasick automaton holds strict and soft terms.  A match counts only where
neither neighbour is a letter or digit of ASCII.  A URL is rejected on one strict term, or when
the weights of its distinct soft terms reach ``soft_limit``: no single one does, two do if one of them is
heavy, three always do.

Rules are (action, host, path prefix).  A rule fits its host and all subdomains, when the URL's
path starts with the rule's path; the longest fitting rule (host plus path) decides.

Edge cases: a null URL, or one without ``://``, has an empty host and path and no rule; a null URL
has no terms and is allowed.  Repeated rows are judged one by one; an empty table gives none.
Vocabulary and rules are parameters of fixed size, so nothing shipped to tasks grows with the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rows, workspace

STRICT = (
    "adult", "porn", "porno", "pornos", "pornography", "xxx", "hardcore", "hentai", "milf", "nsfw", "escort", "escorts", "camgirl", "camgirls", "sexcam", "sexcams", "livesex",
    "casino", "casinos", "viagra", "cialis", "warez", "malware", "phishing", "spam", "spammer", "adserver", "adservers", "adserving", "adclick", "doubleclick", "clickbank",
)
#: Soft terms by weight: 2 for such as are rarely met on clean sites, 1 for such as are common there, too.
SOFT = dict.fromkeys((
    "sex", "sexy", "erotic", "erotica", "nude", "nudes", "hookup",
    "poker", "bet", "bets", "betting", "gambling", "roulette", "blackjack", "lottery", "slots", "jackpot",
    "payday", "forex", "pill", "pills", "steroids", "weightloss", "torrent", "torrents", "cracked", "cracks", "keygen",
    "replica", "replicas", "freebie", "freebies",
    "ad", "ads", "adv", "adverts", "banner", "banners", "popup", "popups", "popunder", "affiliate", "affiliates",
    "trackers", "clicktrack", "backlink", "backlinks", "linkfarm", "spyware", "adware", "scam",
), 2) | dict.fromkeys((
    "dating", "webcam", "webcams", "bingo", "slot", "bonus", "win", "winner", "prize", "prizes", "loan", "loans",
    "pharmacy", "crack", "hack", "hacks", "cheap", "free",
    "advert", "advertising", "sponsor", "sponsored", "track", "tracker", "tracking", "click", "clicks", "seo",
), 1)
SOFT_LIMIT = 3
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = [T.StructField("n_strict", T.IntegerType()), T.StructField("n_soft", T.IntegerType()), T.StructField("soft_weight", T.IntegerType())]


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    return F.translate(_part(url, 1), UPPER, LOWER), _part(url, 2)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule text, action) of the longest fitting rule, nulls without one."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def automaton(strict: Sequence[str], soft: Mapping[str, int]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for word in strict:
        a.add_word(word, (word, 0))
    for word, weight in soft.items():
        if word not in a:
            a.add_word(word, (word, weight))
    a.make_automaton()
    return a


def count_terms(url: str | None, a) -> tuple[int, int, int]:
    """Distinct strict terms, distinct soft terms, and the weight of the latter."""
    if not url or not len(a):
        return 0, 0, 0
    low = url.translate(_ASCII_LOWER)
    strict, soft = set(), {}
    for end, (word, weight) in a.iter(low):
        start = end - len(word) + 1
        if (start and low[start - 1] in _INSIDE) or (end + 1 < len(low) and low[end + 1] in _INSIDE):
            continue
        if weight:
            soft[word] = weight
        else:
            strict.add(word)
    return len(strict), len(soft), sum(soft.values())


_ASCII_LOWER = str.maketrans(UPPER, LOWER)
_INSIDE = frozenset(LOWER + "0123456789")


def count_vocabulary(df: DataFrame, url: str = "url", strict: Sequence[str] = STRICT, soft: Mapping[str, int] = SOFT) -> DataFrame:
    """``df`` with FIELDS for each URL."""
    strict, soft, held = tuple(strict), dict(soft), {}

    def work(column: pa.Array) -> list[pa.Array]:
        if not held:  # once per task
            held["a"] = automaton(strict, soft)
        found = [count_terms(u, held["a"]) for u in column.to_pylist()]
        return [pa.array([x[i] for x in found], pa.int32()) for i in range(3)]

    return rows.extend(df, url, FIELDS, work)


def judge(df: DataFrame, url: str = "url", *, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Mapping[str, int] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """``df`` with host, path, rule, FIELDS and verdict."""
    own = {"host", "path", "rule", "verdict"}
    df = count_vocabulary(df, url, strict, soft)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own or c == url])
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    rule, action = matching_rule(host, path, rules)
    bad = (F.col("n_strict") > 0) | (F.col("soft_weight") >= soft_limit)
    return df.select("*", host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(action, F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every URL of ``pages``."""
    pages = workspace.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def oracle_sql() -> str:
    low = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    term = "CAST(regexp_matches(u, '(^|[^a-z0-9]){0}([^a-z0-9]|$)') AS INTEGER)".format
    soft = " + ".join(f"{w} * {term(t)}" for t, w in SOFT.items())
    strict = " + ".join(term(t) for t in STRICT)
    ordered = sorted(RULES, key=lambda r: -(len(r[1]) + len(r[2])))
    fits = "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}'))".format
    cases = lambda pick: "CASE " + " ".join(f"WHEN {fits(r[1], r[2])} THEN '{pick(r)}'" for r in ordered) + " END"
    return rf"""
WITH p AS (
  SELECT page_id, {low} AS u,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r AS (SELECT *, {cases(lambda r: r[1] + r[2])} AS rule, {cases(lambda r: r[0])} AS act,
             {strict} AS n_strict, {soft} AS soft_weight FROM p)
SELECT page_id, host, path, rule,
       coalesce(act, CASE WHEN n_strict > 0 OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM r
"""
