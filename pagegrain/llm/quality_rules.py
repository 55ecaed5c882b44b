"""Quality rules: learned decision lists over text statistics, DataFrame and SQL functions only.

Statistics of whole texts are column expressions inside one stage: no shuffle, no Python.  Fixed base
rules come first; the rest of the verdict is a decision list learned from labelled statistics by
sequential covering:

* grow: add the threshold condition of the highest information gain until a rule covers no good
  text, or nothing gains;
* prune: cut the conditions at the end that do not help on a third of the rows kept aside;
* keep the rule if its precision is at least ``MIN_PRECISION``, drop what it covers, go on.

Each step is one aggregation by (feature, threshold bin): the driver sees those counts only.  Rules
become an ordered ``CASE WHEN``.  Fitting uses at most ``FIT_ROWS`` labelled documents, those with the
smallest hash of their id (so many ids are broadcast); thresholds are quantiles of these rows.

Words are ``[^\\x20\\x09-\\x0D]+``.  n_repeat_words counts the words inside 8-word windows found twice
or more in the text: window hashes are sorted with their positions inside the row, neighbours
compared, and the covered words added up; texts without a repeated window skip the sort.

Edge cases: a null text has no words and fails the base rule, like an empty one.  Null labels and ids
teach nothing, several labels of an id count as their smallest.  Without labels of both
kinds there are no rules.  Repeated rows are judged one by one; input columns that have a result's name are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workspace

FIT_ROWS = 20_000
MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_PRECISION = 0.97
MIN_COVER = 4
QUANTILES = 24
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbol_rate", "upper_rate", "bang_rate", "run_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "mean_word", "short_word_rate")
_SPACES = r"[\\x20\\x09-\\x0D]+"

#: Steps of column expressions; each one sees the columns of those before.
_STEPS = (
    {
        "__words": rf"filter(split(__text, '{_SPACES}', -1), w -> w <> '')",
        "__lines": r"filter(split(__text, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')",
        "n_symbols": r"cast(length(regexp_replace(__text, '[^#*$%&|<>]+', '')) as long)",
        "__upper": r"length(regexp_replace(__text, '[^A-Z]+', ''))",
        "__bangs": r"length(regexp_replace(__text, '[^!]+', ''))",
    },
    {
        "n_words": "cast(size(__words) as long)",
        "word_chars": "cast(length(array_join(__words, '')) as long)",
        "__n_lines": "size(__lines)",
        "n_dup_lines": "cast(size(__lines) - size(array_distinct(__lines)) as long)",
        "__short": "size(filter(__words, w -> length(w) <= 1))",
        "__hash": "transform(__words, w -> xxhash64(w))",
    },
    {
        "__runs": "size(filter(__hash, (h, i) -> i > 0 and h = get(__hash, i - 1)))",
        "__distinct": "size(array_distinct(__hash))",
        "__win": "case when n_words >= 8 then transform(sequence(0, size(__hash) - 8), i -> xxhash64(slice(__hash, i + 1, 8))) else cast(array() as array<bigint>) end",
    },
    {"__sorted": "case when size(array_distinct(__win)) < size(__win) then sort_array(transform(__win, (h, i) -> struct(h as h, i as i))) else cast(array() as array<struct<h:bigint,i:int>>) end"},
    {"__at": "sort_array(transform(filter(__sorted, (x, k) -> (k > 0 and x.h = get(__sorted, k - 1).h) or coalesce(x.h = get(__sorted, k + 1).h, false)), x -> x.i))"},
    {"n_repeat_words": "aggregate(transform(__at, (p, k) -> least(8, coalesce(get(__at, k + 1) - p, 8))), 0L, (a, x) -> a + x)"},
    {
        "symbol_rate": "n_symbols / greatest(n_words, 1)",
        "upper_rate": "__upper / greatest(word_chars, 1)",
        "bang_rate": "__bangs / greatest(n_words, 1)",
        "run_rate": "__runs / greatest(n_words, 1)",
        "dup_line_rate": "n_dup_lines / greatest(__n_lines, 1)",
        "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
        "distinct_rate": "__distinct / greatest(n_words, 1)",
        "mean_word": "word_chars / greatest(n_words, 1)",
        "short_word_rate": "__short / greatest(n_words, 1)",
        "base_failed": "n_words < 20 or 100 * n_repeat_words > 30 * n_words",
    },
)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with BASE, FEATURES and base_failed.

    The results leave through a generator: a filter on one of them would else be pushed below all
    steps, with each step's expressions copied into the next.
    """
    new = {*BASE, *FEATURES, "base_failed"}
    kept = [c for c in docs.columns if c.lower() not in new]
    df = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    for step in _STEPS:
        df = df.select("*", *[F.expr(e).alias(n) for n, e in step.items()])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*BASE, "base_failed", *FEATURES))))


@dataclass(frozen=True)
class Condition:
    """``feature`` above (or not above) a threshold; cut: index of that threshold."""

    feature: str
    above: bool
    threshold: float
    cut: int

    def sql(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def _thresholds(df: DataFrame) -> dict[str, list[float]]:
    """Quantiles of each feature over all rows and over the bad ones."""
    q = [i / QUANTILES for i in range(QUANTILES)]
    both = [F.percentile_approx(F.when(c, F.col(f)), q, 2000).alias(f"{f}_{k}") for f in FEATURES for k, c in enumerate((F.lit(True), F.col("bad") == 1))]
    row = df.agg(*both).first()
    return {f: sorted({float(v) for k in (0, 1) for v in (row[f"{f}_{k}"] or [])}) for f in FEATURES}


def _tally(df: DataFrame, taken: Sequence[Rule], conditions: Sequence[Condition]) -> dict[tuple[int, int, int], tuple[int, int]]:
    """(rows, bad rows) by (part, feature, bin), of rows that no rule takes and all conditions hold for."""
    for r in taken:
        df = df.where(f"NOT ({r.sql()})")
    for c in conditions:
        df = df.where(c.sql())
    return {(r["part"], r["f"], r["bin"]): (r["n"], r["b"]) for r in df.select("part", "bad", F.posexplode("bins").alias("f", "bin")).groupBy("part", "f", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("b")).collect()}


def _best(tally: dict, cuts: dict[str, list[float]]) -> tuple[float, Condition | None]:
    """The condition of the highest FOIL gain on the growing part."""
    total = [sum(v[k] for (part, f, _), v in tally.items() if part == 0 and f == 0) for k in (0, 1)]
    if not total[1]:
        return 0.0, None
    before, best = math.log2(total[1] / total[0]), (0.0, None)
    for f, name in enumerate(FEATURES):
        n = b = 0
        for cut, threshold in enumerate(cuts[name]):
            got = tally.get((0, f, cut), (0, 0))
            n, b = n + got[0], b + got[1]
            for above, rows, bad in ((False, n, b), (True, total[0] - n, total[1] - b)):
                if bad and rows < total[0]:
                    gain = bad * (math.log2(bad / rows) - before)
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(name, above, threshold, cut))
    return best


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> list[Rule]:
    """An ordered list of rules that reject."""
    known = labels.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{label}`").alias("__label")).where("__id is not null and __label is not null")
    known = known.groupBy("__id").agg(F.min("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    chosen = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known), "__id")
    rows = with_statistics(chosen).where("not base_failed").select(F.when(F.pmod(F.xxhash64("__id", F.lit(3)), F.lit(3)) == 0, 1).otherwise(0).alias("part"), (F.col("__label") != 1).cast("int").alias("bad"), *FEATURES)
    rows = workspace.written(rows.repartition(8), "rule-rows")
    cuts = _thresholds(rows)
    if not all(cuts.values()):
        return []
    bins = F.array(*[F.expr(f"size(filter(array({', '.join(f'{t!r}D' for t in cuts[f])}), t -> {f} > t))") for f in FEATURES])
    rows = workspace.written(rows.withColumn("bins", bins), "rule-bins")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        conditions: list[Condition] = []
        tally = _tally(rows, rules, conditions)
        seen = []
        while len(conditions) < MAX_CONDITIONS:
            gain, condition = _best(tally, cuts)
            if condition is None or gain <= 0:
                break
            conditions.append(condition)
            tally = _tally(rows, rules, conditions)
            count = {part: [sum(v[k] for (p, f, _), v in tally.items() if p == part and f == 0) for k in (0, 1)] for part in (0, 1)}
            seen.append(count)
            if count[0][0] == count[0][1]:
                break
        if not conditions:
            break

        def worth(count: dict) -> float:
            n, b = count[1]
            return (2 * b - n) / n if n else 0.0

        keep = max(range(len(seen)), key=lambda i: (worth(seen[i]), -i))
        n, b = (seen[keep][0][k] + seen[keep][1][k] for k in (0, 1))
        if b < MIN_COVER or b < MIN_PRECISION * n:
            keep = len(seen) - 1  # the whole rule may still do
            n, b = (seen[keep][0][k] + seen[keep][1][k] for k in (0, 1))
            if b < MIN_COVER or b < MIN_PRECISION * n:
                break
        rules.append(Rule(_centred(rows, rules, conditions[:keep + 1]), b, n - b))
    return rules


def _centred(df: DataFrame, taken: Sequence[Rule], conditions: Sequence[Condition]) -> tuple[Condition, ...]:
    """The conditions with each threshold half-way between the nearest values on its two sides."""
    for r in taken:
        df = df.where(f"NOT ({r.sql()})")
    sides = [F.expr(f"{agg}(CASE WHEN {c.feature} {op} {c.threshold!r}D THEN {c.feature} END)").alias(f"{side}{i}") for i, c in enumerate(conditions) for side, agg, op in (("lo", "max", "<="), ("hi", "min", ">"))]
    row = df.agg(*sides).first()
    return tuple(replace(c, threshold=(row[f"lo{i}"] + row[f"hi{i}"]) / 2) if row[f"lo{i}"] is not None and row[f"hi{i}"] is not None else c for i, c in enumerate(conditions))


def verdict(rules: Sequence[Rule]) -> Column:
    """Number (from 1) of the first rule that holds, or null."""
    if not rules:
        return F.lit(None).cast("int")
    return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN {i}" for i, r in enumerate(rules, 1)) + " END").cast("int")


def judge(docs: DataFrame, rules: Sequence[Rule], *, text: str = "text") -> DataFrame:
    """``docs`` with statistics, base_failed, rule (null if none) and kept."""
    df = with_statistics(docs, text)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("rule", "kept") or c == text])
    return df.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document."""
    docs = workspace.table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(docs, workspace.table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", *BASE, "base_failed", "kept", "rule")
