"""A user's function over rows: retried, with its status, error and time as columns."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def enrich(df: DataFrame, keys: list[str], inputs: list[str], call: Callable[..., str], attempts: int = 4, delay: float = 1.0, give_up: tuple[type[Exception], ...] = (ValueError,)) -> DataFrame:
    """(keys, output, status, error_message, retry_count, call_seconds) of ``call`` on the input columns of each row.

    A failed call is repeated after delay * 2^attempt seconds, unless its error is one of ``give_up``; errors end up in the
    row, never in the job. Executors may be lost, so a call may happen twice: it must be safe to repeat.
    """
    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                began, error, result, n = time.time(), None, None, 0
                for n in range(attempts):
                    try:
                        result, error = call(*row[len(keys) :]), None
                        break
                    except give_up as e:
                        error = str(e)
                        break
                    except Exception as e:  # noqa: BLE001
                        error = str(e)
                        if n + 1 < attempts:
                            time.sleep(delay * 2**n)
                out.append((*row[: len(keys)], result, "failed" if error is not None else "completed", error, n, time.time() - began))
            yield pd.DataFrame(out, columns=[*keys, "output", "status", "error_message", "retry_count", "call_seconds"])

    return df.select(*keys, *inputs).mapInPandas(run, f"{types}, output string, status string, error_message string, retry_count int, call_seconds double")


def until_first_failure(df: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of each key up to and with its first failed one."""
    first = F.min(F.when(F.col("status") == "failed", F.col(order))).over(W.partitionBy(key))
    return df.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(order) <= F.col("_first"))).drop("_first")


def call_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows, completed and failed ones, tokens in and out, and the mean time of completed rows."""
    done = F.col("status") == "completed"
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_if(done).alias("n_completed"), F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"),
        F.round(F.count_if(done) * 100.0 / F.count("*"), 2).alias("success_rate"), 
        # whole micro-seconds are added up, so that the order of the rows does not show in the mean
        F.round(F.sum(F.when(done, F.round(F.col("translation_time") * 1000000).cast("long"))) / F.nullif(F.count_if(done & F.col("translation_time").isNotNull()), F.lit(0)) / 1000000, 4).alias("avg_seconds"),
    )
