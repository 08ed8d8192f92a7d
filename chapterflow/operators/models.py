"""Applying user-supplied recognisers and models to request tables."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Requests of a task whose prompts and answers are in memory at once.
REQUESTS = 64
#: Columns of the attempt log behind the key.
LOG_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]
_MODELS: dict[str, Callable[[str], str]] = {}


class TransientError(Exception):
    """Worth retrying (rate limit, server error)."""


class PermanentError(Exception):
    """Not worth retrying."""


class TokenBucket:
    """At most ``rate`` calls a second on average and ``burst`` at once; ``take`` waits for its turn."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.lock, self.tokens, self.at = threading.Lock(), float(burst), clock()

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate) - 1
            self.at, wait = now, max(0.0, -self.tokens / self.rate)
        if wait:
            self.sleep(wait)


def register_model(name: str, call: Callable[[str], str]) -> None:
    _MODELS[name] = call


def apply_model(
    requests: DataFrame,
    names: list[str],
    prompt_col: str = "prompt",
    key_col: str = "request_id",
    max_retries: int = 2,
    base_delay_s: float = 1.0,
    max_delay_s: float = 10.0,
    partitions: int | None = None,
    concurrency: int = 8,
    calls_per_s: float | None = None,
) -> DataFrame:
    """Attempt log of calling models in fallback order for every request.

    Requests are spread evenly first, since calls cost far more than rows.
    Transient errors are retried with doubling delays, permanent ones move on
    to the next model. One row per attempt; ``resolve_attempts`` picks the
    outcome. A task has up to ``concurrency`` requests under way and starts
    at most ``calls_per_s`` calls a second; with ``partitions`` tasks that
    bounds all calls together. The log keeps the order of the requests and of
    each one's attempts, as if they were made one by one. Attempts stream out
    batch by batch; a request that waits holds one thread, no row.
    """
    calls = [(n, _MODELS[n]) for n in names]
    key_type = dict(requests.dtypes)[key_col]
    schema = (
        f"{key_col} {key_type}, model_order int, attempt int, provider string, success boolean, "
        "error_class string, error_message string, response string"
    )

    def attempts(key, prompt: str, bucket: TokenBucket | None) -> Iterator[tuple]:
        number = 0
        for order, (name, call) in enumerate(calls):
            for retry in range(max_retries + 1):
                number += 1
                if bucket:
                    bucket.take()
                try:
                    yield key, order, number, name, True, None, None, call(prompt)
                    return
                except TransientError as e:
                    yield key, order, number, name, False, "transient", str(e), None
                    if retry < max_retries:
                        time.sleep(min(base_delay_s * 2**retry, max_delay_s))
                except Exception as e:  # noqa: BLE001 - any other failure is permanent for this model
                    yield key, order, number, name, False, "permanent", str(e), None
                    break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_out = [f.split()[0] for f in schema.split(", ")]
        bucket = None if calls_per_s is None else TokenBucket(calls_per_s, max(1, concurrency))
        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for batch in batches:
                # Prompts and answers of a few requests at a time are in Python's memory.
                for lo in range(0, batch.num_rows, REQUESTS):
                    some = batch.slice(lo, REQUESTS)
                    logs = pool.map(lambda key, prompt: list(attempts(key, prompt, bucket)), some.column(0).to_pylist(), some.column(1).to_pylist())
                    rows = [row for log in logs for row in log]
                    types = [some.schema.field(0).type, *LOG_TYPES]
                    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names_out)

    narrow = requests.select(key_col, prompt_col)
    spread = narrow.repartition(partitions, key_col) if partitions else narrow.repartition(key_col)
    return spread.mapInArrow(run, schema)


def resolve_attempts(attempts: DataFrame, key_col: str = "request_id") -> DataFrame:
    """First success per request in attempt order, else its last error."""
    won = F.when(F.col("success"), F.col("attempt"))
    row = F.struct("attempt", "provider", "success", "error_class", "error_message", "response")
    best = attempts.groupBy(key_col).agg(
        F.coalesce(F.min_by(row, won), F.max_by(row, "attempt")).alias("x"), F.count(F.lit(1)).alias("n_attempts")
    )
    return best.select(key_col, "n_attempts", "x.*")
