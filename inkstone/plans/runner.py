"""Runs named stages one after the other; each is stored before the next begins, and the first failure ends the run."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from inkstone.session import finished

Stage = tuple[str, Callable[[SparkSession, DataFrame | None], DataFrame]]


@dataclass(frozen=True)
class Run:
    """What became of a stage."""

    stage: str
    place: int
    status: str
    rows: int
    seconds: float


class StageFailed(RuntimeError):
    """A stage that ended with an error; runs are those up to and with it."""

    def __init__(self, runs: list[Run]) -> None:
        super().__init__(f"{runs[-1].stage} failed")
        self.runs = runs


def run_stages(spark: SparkSession, stages: list[Stage]) -> tuple[list[Run], DataFrame | None]:
    """The runs, and what the last stage made; each stage gets the session and what the one before it made."""
    runs: list[Run] = []
    made = None
    for place, (name, stage) in enumerate(stages, 1):
        began = time.time()
        try:
            made = finished(spark, lambda stage=stage, made=made: stage(spark, made), "stage")
            rows, status, error = made.count(), "passed", None
        except Exception as e:  # noqa: BLE001  whatever a stage raises is its failure
            rows, status, error = 0, "failed", e
        runs.append(Run(name, place, status, rows, time.time() - began))
        if error is not None:
            raise StageFailed(runs) from error
    return runs, made
