"""Answers from a user's callable: open requests in, an answer table out.

The callable runs where the requests lie, partition by partition. A request that fails becomes a row with its error, never a
failed job, and what is answered is never asked again, so a stopped run goes on where it was.
"""

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.products import not_in
from ..sources.paths import has_data

ANSWERS = "request_key string, kind string, body string, error string, answered_at timestamp"
Ask = Callable[[dict], str | None]


def load_attempts(spark: SparkSession, path: str) -> DataFrame:
    """Every call made so far: request_key, kind, body, error (null where the call went well), answered_at."""
    return spark.read.schema(ANSWERS).parquet(path) if has_data(spark, path) else spark.createDataFrame([], ANSWERS)


def load_answers(spark: SparkSession, path: str) -> DataFrame:
    """request_key, kind, body, answered_at of the calls that went well: a response table for a run."""
    return load_attempts(spark, path).filter("error is null and body is not null").drop("error")


def open_requests(requests: DataFrame, attempts: DataFrame, most: int | None = None) -> DataFrame:
    """Requests without a good answer; with `most` also without those that failed so many times."""
    calls = attempts.groupBy("request_key").agg(F.count_if(F.col("error").isNull()).alias("good"), F.count(F.lit(1)).alias("calls"))
    done = F.col("good") > 0
    return not_in(requests, calls.filter(done if most is None else done | (F.col("calls") >= most)), "request_key")


def ask_provider(requests: DataFrame, provider: Callable[[], Ask], seconds: float | None = None) -> DataFrame:
    """ANSWERS of `requests` (request_key, kind and whatever the provider reads).

    `provider` is called once per task and gives the function that answers one request, a dict of its columns, with a text or
    None (nothing to say). An exception or an answer that is no text is kept as the row's error. After `seconds` a task starts
    no further call: the rest of its requests give no row and stay open. A task that Spark repeats calls again.
    """

    def work(frames):
        ask, start = provider(), time.monotonic()
        for frame in frames:
            rows = []
            for request in frame.to_dict("records"):
                if seconds is not None and time.monotonic() - start >= seconds:
                    break
                body = error = None
                try:
                    body = ask(request)
                    if body is not None and not isinstance(body, str):
                        body, error = None, f"TypeError: the answer is no text but {type(body).__name__}"
                except Exception as problem:  # noqa: BLE001
                    error = f"{type(problem).__name__}: {problem}"
                rows.append((request["request_key"], request["kind"], body, error, pd.Timestamp.now(tz="UTC")))
            yield pd.DataFrame(rows, columns=["request_key", "kind", "body", "error", "answered_at"]).astype(
                {"request_key": "object", "kind": "object", "body": "object", "error": "object", "answered_at": "datetime64[us, UTC]"})

    return requests.mapInPandas(work, ANSWERS)


def answer_requests(
    requests: DataFrame,
    provider: Callable[[], Ask],
    path: str,
    tasks: int | None = None,
    slices: int = 1,
    seconds: float | None = None,
    most: int | None = None,
) -> DataFrame:
    """Ask for every open request, append what came to the table at `path`, and return its good answers.

    `tasks` bounds the calls made at a time. The requests are dealt into `slices`, each committed when it is through, so a job
    that is killed loses the calls of one slice. Pass a stored table: it is read once per slice.
    """
    spark = requests.sparkSession
    for n in range(slices):
        own = requests.filter(F.pmod(F.xxhash64("request_key"), F.lit(slices)) == n) if slices > 1 else requests
        todo = open_requests(own, load_attempts(spark, path), most)
        ask_provider(todo.repartition(tasks) if tasks else todo, provider, seconds).write.mode("append").parquet(path)
    return load_answers(spark, path)
