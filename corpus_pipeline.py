"""Corpus pipeline: five stages over ``documents``, each written and read again as the next one's input.

1. quality classifier: documents whose score is under the threshold go.
2. quality rules: documents that a base rule or a learned rule rejects go.
3. n-gram Jaccard join: of each group linked by 5-word n-grams at a similarity of 0.8 or more, one
   row stays, that with the smallest id.  Rows are judged one by one, also those that share an id.
4. benchmark decontamination: documents with any window of a benchmark item go.
5. BPE encoding and decoding: number and digest of the ids, digest of the decoded text.

Stages 1 and 2 fit on labelled documents among their own input (at most FIT_ROWS of each operator).
A stage keeps the columns of its input, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import bpe, decontaminate, ngram_join, quality_crf, quality_rules, workspace

K_WORDS, NUM, DEN = 5, 80, 100


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _filtered(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], new: set[str], keep) -> DataFrame:
    """Rows of ``docs`` that ``judge`` keeps.  Input columns that have a name of its results travel in a struct."""
    if any(c.lower() in new for c in docs.columns):
        return judge(docs.select(F.struct(*_own(docs)).alias("__row"), "doc_id", "text")).where(keep).select("__row.*")
    return judge(docs).where(keep).select(*_own(docs))


def _names(fields) -> set[str]:
    return {f.name for f in fields}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_crf.learn(docs.select("doc_id", "text"), workspace.table(spark, sf_dir, "labels"))
    return _filtered(docs, lambda d: quality_crf.classify(d, model), _names(quality_crf.FIELDS), F.col("score") >= quality_crf.THRESHOLD)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = quality_rules.learn(docs.select("doc_id", "text"), workspace.table(spark, sf_dir, "labels"))
    new = {*quality_rules.BASE, *quality_rules.FEATURES, "base_failed", "rule", "kept"}
    return _filtered(docs, lambda d: quality_rules.judge(d, learned), new, F.col("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, k=K_WORDS, num=NUM, den=DEN)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = workspace.table(spark, sf_dir, "benchmark")
    return _filtered(docs, lambda d: decontaminate.scan_documents(d, items), _names(decontaminate.FIELDS), ~F.col("contaminated"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.transcode(docs.select("doc_id", "text"), tokenizer=bpe.public_spec())
    return out.select("doc_id", *[f.name for f in bpe.FIELDS])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: Learned stages have no SQL; tests compare every stage with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` table; each stage's rows are written and read again."""
    docs = workspace.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = workspace.written(docs, f"pipeline-{k}")
    return docs
