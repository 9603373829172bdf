"""Hooks around a run on the driver: settings, progress, confirmation, cancelling, and runs side by side."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass
class Settings:
    """What a run can be told; from defaults, a JSON file and variables DOCLOOM_NAME of the environment, the later before the earlier."""

    strategy: str = "hybrid"
    max_tokens: int = 800
    overlap: int = 100
    term_limit: int = 20
    attempts: int = 4
    retry_delay: float = 1.0
    validate: bool = True
    auto_correct: bool = True
    threshold: float = 0.8
    least_confidence: float = 0.7

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None) -> Settings:
        given = json.load(open(path)) if path else {}
        for f in fields(cls):
            text = (os.environ if env is None else env).get(f"DOCLOOM_{f.name.upper()}")
            if text is not None:
                kind = type(f.default)
                given[f.name] = text.lower() in ("1", "true", "yes") if kind is bool else kind(text)
        return cls(**{k: v for k, v in given.items() if k in {f.name for f in fields(cls)}})


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with a count of rows, and of failed ones if it has a status, that is there after the next action; costs no pass of its own."""
    seen = Observation(name)
    failed = F.count_if(F.col("status") == "failed") if "status" in df.columns else F.lit(0).cast("long")
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), failed.alias("n_failed")), seen


def run_steps(df: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]], progress: Callable[[str, str], None] | None = None) -> DataFrame:
    """The steps one after the other as one lazy plan; ``progress`` hears of each step and of the first error, which ends the run."""
    for name, step in steps.items():
        try:
            df = step(df)
        except Exception:
            if progress:
                progress(name, "failed")
            raise
        if progress:
            progress(name, "completed")
    return df


def envelope(run: Callable[[], dict]) -> dict:
    """The result of a run or its error, never an exception."""
    try:
        return {"success": True, "error": None, **run()}
    except Exception as e:  # noqa: BLE001
        return {"success": False, "error": str(e)}


def sync(plan: DataFrame, apply: Callable[[DataFrame], dict], dry_run: bool = False, auto: bool = False, confirm: Callable[[DataFrame], bool] | None = None) -> dict:
    """What becomes of a plan of changes: nothing to do, shown only, turned down or applied; ``confirm`` stands between plan and change."""
    if plan.where("action <> 'skip'").isEmpty():
        return {"success": True, "state": "nothing"}
    if dry_run:
        return {"success": True, "state": "preview"}
    if not auto and not (confirm and confirm(plan)):
        return {"success": False, "state": "declined"}
    return envelope(lambda: {"state": "applied", **apply(plan)})


class Runner:
    """Runs side by side in driver threads; each has a tag, by which its Spark jobs are cancelled."""

    def __init__(self, spark: SparkSession, threads: int = 4):
        self.spark, self.pool, self.runs = spark, ThreadPoolExecutor(threads), {}

    def submit(self, run: Callable[[], dict]) -> str:
        name = f"run-{uuid.uuid4().hex}"

        def tagged() -> dict:
            self.spark.sparkContext.addJobTag(name)
            try:
                return envelope(run)
            finally:
                self.spark.sparkContext.removeJobTag(name)

        self.runs[name] = self.pool.submit(tagged)
        return name

    def status(self, name: str) -> str:
        run: Future | None = self.runs.get(name)
        if run is None:
            return "unknown"
        if run.cancelled():
            return "cancelled"
        return "running" if not run.done() else "completed" if run.result()["success"] else "failed"

    def result(self, name: str) -> dict:
        return self.runs[name].result()

    def cancel(self, name: str) -> None:
        if name in self.runs and not self.runs[name].cancel():
            self.spark.sparkContext.cancelJobsWithTag(name)

    def shutdown(self) -> None:
        self.pool.shutdown(wait=True)
