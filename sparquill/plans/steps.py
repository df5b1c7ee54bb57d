"""Steps over DataFrames by name, with presets, timing and a status per step."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Step = Callable[[DataFrame], DataFrame]
SCOPES = ("inbox", "papers", "global")


class StepFailed(RuntimeError):
    """A step failed; log holds what ran, the failed step last."""

    def __init__(self, log: list[dict]):
        super().__init__(f"{log[-1]['step']} {log[-1]['status']}")
        self.log = log


@dataclass
class Registry:
    """Named steps in scopes; scopes run in the order inbox, papers, global."""

    steps: dict[str, tuple[str, Step]] = field(default_factory=dict)
    presets: dict[str, list[str]] = field(default_factory=dict)

    def add(self, name: str, scope: str, step: Step) -> None:
        if scope not in SCOPES:
            raise ValueError(f"no scope {scope!r}")
        self.steps[name] = scope, step

    def preset(self, name: str, steps: list[str]) -> None:
        missing = [s for s in steps if s not in self.steps]
        if missing:
            raise ValueError(f"unknown steps: {', '.join(missing)}")
        self.presets[name] = steps

    def plan(self, names: str | list[str]) -> list[str]:
        """Steps of a preset or a list, by scope, otherwise in the order given."""
        chosen = self.presets[names] if isinstance(names, str) else names
        for n in chosen:
            if n not in self.steps:
                raise ValueError(f"unknown step {n!r}")
        return sorted(chosen, key=lambda n: SCOPES.index(self.steps[n][0]))

    def run(self, df: DataFrame, names: str | list[str]) -> DataFrame:
        """One lazy plan: nothing runs until the result is used."""
        for n in self.plan(names):
            df = df.transform(self.steps[n][1])
        return df

    def run_timed(self, df: DataFrame, names: str | list[str], store: Callable[[DataFrame, str], DataFrame], keep_going: bool = False) -> tuple[DataFrame, list[dict]]:
        """Each step written by `store` before the next; gives the last table and (step, status, seconds) of each.

        A step that fails is recorded and ends the run with StepFailed, which has the log; with
        keep_going it passes its input on.
        """
        log = []
        for n in self.plan(names):
            began, status = time.perf_counter(), "ok"
            try:
                df = store(df.transform(self.steps[n][1]), n)
            except Exception as e:  # noqa: BLE001  recorded, with its message
                status = f"failed: {type(e).__name__}: {str(e)[:200]}"
            log.append({"step": n, "status": status, "seconds": time.perf_counter() - began})
            if status != "ok" and not keep_going:
                raise StepFailed(log)
        return df, log


def log_events(spark: SparkSession, log: list[dict], path: str) -> None:
    """Append a run's log to the event table."""
    spark.createDataFrame(log, "step string, status string, seconds double").write.mode("append").parquet(path)
