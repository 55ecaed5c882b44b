"""Job log, result store and cache: append-only Parquet with latest-wins views.

Plain Parquet has no update, so states are events.  Views take the latest event of each key by one aggregation.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls

PIPELINE_VERSION = "pipeline-v1"
EVENT = "job_id string, seq long, input_url string, normalized_url string, status string, progress double, cache_key string, request_config_json string, error_message string, at timestamp"
CACHE = "cache_key string, normalized_url string, config_hash string, job_id string, expires_at string, created_at string"
RESULT = "job_id string, result_json string, created_at string"


def latest_jobs(events: DataFrame) -> DataFrame:
    """The current row of each job: last status and error (also a null one), last progress that was given."""
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return events.groupBy("job_id").agg(known("input_url"), known("normalized_url"), F.max_by("status", "seq").alias("status"), known("progress"), known("cache_key"), known("request_config_json"), F.max_by("error_message", "seq").alias("error_message"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def latest(df: DataFrame, key: str) -> DataFrame:
    """The last row of each key by created_at."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), "created_at").alias("x")).select(key, "x.*")


def valid_cache(entries: DataFrame, results: DataFrame, now: Column | None = None) -> DataFrame:
    """Cache entries that expire strictly later than now and whose result exists; an unreadable time is expired."""
    now = F.current_timestamp() if now is None else now
    return latest(entries, "cache_key").where(F.expr("try_cast(expires_at as timestamp)") > now).join(results.select("job_id").distinct(), "job_id", "left_semi")


def request_config(normalized_url: str, *, max_pages: int = 8, max_depth: int = 2, use_rendered: bool = False, include_html_report: bool = False, enable_html_reports: bool = False, model: str = "offline", embedding_model: str = "hashed-words") -> dict:
    return {"normalized_url": normalized_url, "max_pages": max_pages or 8, "max_depth": max_depth or 2, "use_playwright_fallback": use_rendered, "include_html_report": include_html_report, "enable_html_reports": enable_html_reports, "ollama_model": model, "embedding_model": embedding_model, "pipeline_version": PIPELINE_VERSION}


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


class Store:
    """Tables jobs, results and cache under one folder."""

    def __init__(self, spark: SparkSession, path: str, ttl_hours: int = 24):
        self.spark, self.path, self.ttl_hours = spark, path.rstrip("/"), ttl_hours

    def _append(self, name: str, row: tuple, schema: str) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def jobs(self) -> DataFrame:
        return latest_jobs(self._read("jobs", EVENT))

    def results(self) -> DataFrame:
        return latest(self._read("results", RESULT), "job_id")

    def create(self, input_url: str, config: dict) -> str:
        job_id, now = str(uuid.uuid4()), datetime.now(UTC)
        self._append("jobs", (job_id, _seq(now), input_url, config["normalized_url"], "queued", 0.0, f"audit:{config_hash(config)}", json.dumps(config, sort_keys=True), None, now), EVENT)
        return job_id

    def update(self, job_id: str, status: str, progress: float | None = None, error: str | None = None) -> None:
        now = datetime.now(UTC)
        self._append("jobs", (job_id, _seq(now), None, None, status, progress, None, None, error, now), EVENT)

    def job(self, job_id: str) -> dict | None:
        row = self.jobs().where(F.col("job_id") == job_id).first()
        return row.asDict() if row else None

    def save_result(self, job_id: str, result: dict) -> None:
        self._append("results", (job_id, json.dumps(result), datetime.now(UTC).isoformat()), RESULT)

    def result(self, job_id: str) -> dict | None:
        row = self.results().where(F.col("job_id") == job_id).first()
        return json.loads(row["result_json"]) if row else None

    def save_cache(self, job: dict) -> None:
        if job.get("cache_key"):
            now = datetime.now(UTC)
            self._append("cache", (job["cache_key"], job["normalized_url"], job["cache_key"].removeprefix("audit:"), job["job_id"], (now + timedelta(hours=self.ttl_hours)).isoformat(), now.isoformat()), CACHE)

    def cached(self, config: dict, *, force_refresh: bool = False) -> dict | None:
        """The job of a valid cache entry for a request, unless a refresh is forced."""
        if force_refresh:
            return None
        hit = valid_cache(self._read("cache", CACHE), self.results()).where(F.col("cache_key") == f"audit:{config_hash(config)}").first()
        return self.job(hit["job_id"]) if hit else None


def _seq(at: datetime) -> int:
    return int(at.timestamp() * 1_000_000)


def normalized_request(spark: SparkSession, url: str) -> str:
    """Canonical URL of a request; ValueError if it has none."""
    found, error = urls.canonical_one(spark, url)
    if error:
        raise ValueError(error)
    return found


def safe_name(job_id: str) -> str:
    """File name of a job's report: no part of an id can leave the folder."""
    return (re.sub(r"[^A-Za-z0-9_.-]+", "-", job_id).strip(".-") or "report") + ".html"
