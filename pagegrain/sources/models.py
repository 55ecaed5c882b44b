"""Model outputs from a text generation service over HTTP.

Requests go out from the executors, one per prompt.  An answer that cannot be read is sent back once for
repair, so a prompt has at most two rows; failures of the service are rows with an error.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.model_output import read_answer
from ..operators.prompts import MAX_ERROR, MAX_INVALID, SHAPE

OUTPUT = "chunk_id string, attempt int, text string, error string"


def _cut(text: str, limit: int) -> str:
    text = " ".join(text.split())
    return text if len(text) <= limit else text[:limit - 3].rstrip() + "..."


def repair_request(invalid: str, error: str) -> str:
    context = {"invalid_output": _cut(invalid, MAX_INVALID), "validation_error": _cut(error, MAX_ERROR)}
    return "Turn this model output into valid JSON only, keep its recommendations, and match this shape:\n" + SHAPE + "\n" + json.dumps(context)


def generate(url: str, model: str, prompt: str, *, temperature: float, timeout: float) -> str:
    """The text of one answer; OSError or ValueError if the service fails or answers in another form."""
    body = json.dumps({"model": model, "prompt": prompt, "stream": False, "format": "json", "options": {"temperature": temperature}}).encode()
    request = urllib.request.Request(url.rstrip("/") + "/api/generate", body, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        text = json.load(r).get("response")
    if not isinstance(text, str) or not text.strip():
        raise ValueError("the service gave no text")
    return text


def answers(url: str, model: str, *, temperature: float = 0.1, timeout: float = 60.0, repairs: int = 1) -> Callable[[DataFrame], DataFrame]:
    """A function from (chunk_id, prompt) to model outputs, for ``audit_pages`` and ``run_job``."""

    def one(chunk_id: str, prompt: str) -> list[tuple]:
        rows: list[tuple] = []
        for attempt in range(repairs + 1):
            try:
                text = generate(url, model, prompt, temperature=0.0 if attempt else temperature, timeout=timeout)
            except (OSError, ValueError, AttributeError) as e:
                return [*rows, (chunk_id, attempt, None, str(e))]
            rows.append((chunk_id, attempt, text, None))
            error = read_answer(text)["error"]
            if error is None:
                break
            prompt = repair_request(text, error)
        return rows

    def run(batches):
        for pdf in batches:
            found = [r for c, p in zip(pdf["chunk_id"], pdf["prompt"], strict=True) for r in one(c, p)]
            yield pd.DataFrame(found, columns=["chunk_id", "attempt", "text", "error"]).astype({"attempt": "int32"})

    return lambda prompts: prompts.select("chunk_id", "prompt").mapInPandas(run, OUTPUT)
