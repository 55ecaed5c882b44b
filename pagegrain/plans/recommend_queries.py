"""Recommendations derived from ``orders``: a customer is a page, an order names what the page lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate
from .registry import query, table

LACKS = {"1-URGENT": "Call to action", "2-HIGH": "Customer proof", "3-MEDIUM": "Opening hours", "4-NOT SPECIFIED": "Next step", "5-LOW": "Case study"}
LEVELS = {"F": "high", "O": "medium", "P": "low"}
AREAS = {"F": "clarity", "O": "cta", "P": "structure"}
TYPES = ("homepage", "pricing", "other", "docs")
SIGNALS = ((), ("missing_cta",), ("missing_cta", "generic_cta", "thin_page"))


def _case(name: str, words: dict) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + " END"


def _cases(name: str, words: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {name} % {len(words)} = {i} THEN {w}" for i, w in enumerate(words)) + " END"


#: Every second order writes the same in capitals and with more blanks.
_ROWS = f"""SELECT o_custkey AS page_ord, o_orderkey AS rec_ord, concat('https://shop.example/', o_custkey) AS page_url,
CASE WHEN o_orderkey % 2 = 0 THEN {_case('o_orderpriority', LACKS)} ELSE concat(' ', upper(replace({_case('o_orderpriority', LACKS)}, ' ', '  '))) END AS missing_content,
{_case('o_orderpriority', {k: 'Add: ' + v for k, v in LACKS.items()})} AS suggestion_or_outline, 'From the order' AS reason,
{_case('o_orderstatus', LEVELS)} AS priority, {_case('o_orderstatus', AREAS)} AS area, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS confidence,
{_cases('o_custkey', tuple(f"'{t}'" for t in TYPES))} AS page_type"""


def _score(category: str) -> str:
    bonus = "CASE {0} WHEN 'cta' THEN 7.0 WHEN 'trust' THEN 6.0 WHEN 'missing_context' THEN 4.5 ELSE 3.0 END".format(category)
    page = "CASE page_type WHEN 'homepage' THEN 8.0 WHEN 'pricing' THEN 7.0 WHEN 'docs' THEN 2.5 ELSE 0.0 END"
    n = f"CASE WHEN {category} = 'cta' THEN page_ord % 3 WHEN {category} = 'missing_context' AND page_ord % 3 = 2 THEN 1 ELSE 0 END"
    points = "CASE priority WHEN 'high' THEN 64.0 WHEN 'medium' THEN 44.0 WHEN 'low' THEN 24.0 END"
    return f"""CAST(round(least(100.0, CAST({points} AS DOUBLE) + confidence * 12 + {page} + {bonus} + 4 * {n}), 1) AS DOUBLE) AS priority_score,
concat(concat_ws('; ', concat(priority, ' severity'), concat(printf('%.2f', confidence), ' confidence'), CASE WHEN page_type <> 'other' THEN concat(page_type, ' page') END,
  CASE WHEN {bonus} >= 4 THEN concat(replace({category}, '_', ' '), ' issue') END, CASE {n} WHEN 1 THEN 'supported by heuristic signal' WHEN 2 THEN 'supported by heuristic signals' END), '.') AS why_prioritized"""


_BEST = f"""WITH r AS ({_ROWS} FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY page_url, suggestion_or_outline ORDER BY confidence DESC, rec_ord) AS n, min(rec_ord) OVER (PARTITION BY page_url, suggestion_or_outline) AS first FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, confidence DESC, first) AS place,
  CASE WHEN suggestion_or_outline IN ('Add: Call to action', 'Add: Next step') THEN 'cta' WHEN suggestion_or_outline IN ('Add: Customer proof', 'Add: Case study') THEN 'trust' ELSE 'missing_context' END AS category
  FROM k WHERE n = 1)
"""


def _recommended(spark, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("__orders")
    rows = spark.sql(_ROWS + " FROM __orders")
    lists = [F.array(*map(F.lit, s)).cast("array<string>") for s in SIGNALS]
    return rows.withColumn("signal_types", F.get(F.array(*lists), (F.col("page_ord") % len(SIGNALS)).cast("int")))


@query(_BEST + f"SELECT page_url, place, missing_content, priority, confidence, category, {_score('category')} FROM b")
def missing_content(spark, sf_dir):
    """Missing content of each page, each kind once, ranked and scored."""
    best = aggregate.dedupe_missing(_recommended(spark, sf_dir))
    best = best.withColumn("category", aggregate.missing_category(F.col("missing_content"), F.col("suggestion_or_outline"), F.col("reason")))
    best = aggregate.recommendation_priority(best, level="priority")
    return best.select("page_url", F.col("place").cast("long").alias("place"), "missing_content", "priority", "confidence", "category", "priority_score", "why_prioritized")


@query(_BEST + f""", a AS (
SELECT 'improvement' AS type, 0 AS kind, area AS category, *, {_score('area')} FROM b WHERE place <= {aggregate.MAX_IMPROVEMENTS}
UNION ALL BY NAME SELECT 'missing_content' AS type, 1 AS kind, *, {_score('category')} FROM b WHERE place <= {aggregate.MAX_MISSING})
SELECT type, page_url, category, priority AS severity, confidence, priority_score, why_prioritized, missing_content AS issue, suggestion_or_outline AS suggestion FROM a WHERE priority IN ('high', 'medium')
ORDER BY priority_score DESC, CASE priority WHEN 'high' THEN 2 ELSE 1 END DESC, confidence DESC, page_ord, kind, place LIMIT {aggregate.MAX_PRIORITIES}""".replace("area AS category, *", "area AS category, * EXCLUDE (category)"))
def top_priorities(spark, sf_dir):
    """The most urgent recommendations over all pages."""
    rows = _recommended(spark, sf_dir)
    page = ("page_url", "page_ord", "page_type", "signal_types")
    missing = aggregate.dedupe_missing(rows).where(F.col("place") <= aggregate.MAX_MISSING)
    better = rows.select(*page, "rec_ord", "confidence", F.col("area").alias("category"), F.col("priority").alias("severity"), F.col("missing_content").alias("issue"), F.col("suggestion_or_outline").alias("suggested_change"))
    better = aggregate.best_per_key(better, aggregate.dedupe_key(F.col("issue"), F.col("suggested_change")), "severity").where(F.col("place") <= aggregate.MAX_IMPROVEMENTS)

    def listed(df: DataFrame, name: str, *fields: str) -> DataFrame:
        return df.groupBy(*page).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.struct(*fields).alias("x")))), lambda r: r["x"]).alias(name))

    results = listed(missing, "missing_content", "missing_content", "suggestion_or_outline", "reason", "priority", "confidence")
    results = results.join(listed(better, "improvements", "category", "severity", "confidence", "issue", "suggested_change").drop(*page[1:]), "page_url")
    return aggregate.top_priorities(results.withColumn("duplicate_warnings", F.array().cast("array<struct<similarity_score:double,message:string>>")))
