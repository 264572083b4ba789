"""Recognisers as user-supplied functions over chunks."""

from __future__ import annotations

import os
import socket
import threading
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, functions as F

ANSWER = "device string, compute_type string, language string, language_probability double, text string, segments string, provider_model string"
RESULT = f"job_id string, chunk_index int, provider string, {ANSWER}, error string, worker string, model_loads int"
_models: dict[tuple, Any] = {}
_loads: dict[tuple, int] = {}
_lock = threading.Lock()


def cached_model(load: Callable[[str, str, str], Any], model: str, device: str, compute_type: str) -> Any:
    """The loaded model of these three, once in each Python worker."""
    key = (model, device, compute_type)
    with _lock:
        if key not in _models:
            _loads[key] = _loads.get(key, 0) + 1
            _models[key] = load(*key)
        return _models[key]


def most_loads() -> int:
    """How often this process has begun to load the model that it loaded most often; one, as long as loading does not fail."""
    with _lock:
        return max(_loads.values(), default=0)


def batched(provider: Callable[[list[dict]], list[dict]]) -> Callable[[list[dict]], list[dict]]:
    """Marks a provider that takes the chunks of a batch at once and answers in their order."""
    provider.batched = True
    return provider


def _answers(provider: Callable, rows: list[dict]) -> list[dict]:
    """A provider's answers, or the error of each chunk that has none.

    A batch that fails as a whole, or answers too few, is tried again chunk by chunk, so that one bad chunk costs its
    neighbours nothing but time."""
    if getattr(provider, "batched", False) and len(rows) > 1:
        try:
            found = list(provider(rows))
            if len(found) == len(rows):
                return found
        except Exception:  # noqa: BLE001  told apart below
            pass
    out = []
    for row in rows:
        try:
            out.append(provider([row])[0] if getattr(provider, "batched", False) else provider(row))
        except Exception as e:  # noqa: BLE001  becomes the chunk's error
            out.append({"error": f"{type(e).__name__}: {e}"})
    return out


def map_chunks(chunks: DataFrame, providers: dict[str, Callable], profile: ResourceProfile | None = None) -> DataFrame:
    """Each chunk (job_id, chunk_index, provider_name, path, model_name, language, vocabulary, prompt) through the provider
    that it names.

    A provider gets the row as a dict, or with `batched` the rows of its name in a batch, and returns the fields of ANSWER,
    segments as JSON. What it raises becomes the chunk's error, and its other fields are null; an unknown name, null
    included, ends the job, as it is a fault of the settings. worker names the process, and model_loads is its most_loads.
    With a profile Spark runs this stage, and nothing else, on executors that have what it asks for, such as one GPU a
    task; local masters know no profiles. The size of a batch is spark.sql.execution.arrow.maxRecordsPerBatch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in RESULT.split(", ")]
        worker = f"{socket.gethostname()}:{os.getpid()}"
        for batch in batches:
            rows = batch.to_dict("records")
            by_name: dict[str, list[int]] = {}
            for i, row in enumerate(rows):
                if row["provider_name"] not in providers:
                    raise ValueError(f"unknown provider: {row['provider_name']}")
                by_name.setdefault(row["provider_name"], []).append(i)
            out: list[dict] = [{} for _ in rows]
            for name, places in by_name.items():
                for i, answer in zip(places, _answers(providers[name], [rows[i] for i in places])):
                    out[i] = {"job_id": rows[i]["job_id"], "chunk_index": rows[i]["chunk_index"], "provider": name, "worker": worker} | answer
            yield pd.DataFrame(out, columns=names, dtype=object).assign(model_loads=most_loads())  # pandas makes chunked strings otherwise

    return chunks.mapInPandas(run, RESULT, profile=profile)


def failed_jobs(results: DataFrame) -> DataFrame:
    """Of map_chunks' rows, the jobs that cannot go on: job_id, status ERROR, error_message of the first failed chunk, failed_chunks."""
    first = F.min_by("error", F.struct("chunk_index", "error"))
    failed = results.where("error is not null").groupBy("job_id").agg(first.alias("error_message"), F.count("*").alias("failed_chunks"))
    return failed.select("job_id", F.lit("ERROR").alias("status"), "error_message", "failed_chunks")
