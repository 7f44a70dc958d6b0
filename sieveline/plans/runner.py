"""One stage at a time in the background, with a short log: what a web front end would sit on."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_LINES, SHOWN_LINES = 300, 80


class StageRunner:
    """Refuses a stage while another runs; a stage that fails leaves its error in the log."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._lock, self._lines = threading.Lock(), deque(maxlen=LOG_LINES)
        self._stage: str | None = None
        self._thread: threading.Thread | None = None

    @property
    def current(self) -> str | None:
        return self._stage

    def log(self, line: str) -> None:
        self._lines.append(f"{datetime.now(UTC):%H:%M:%S} {line}")

    def recent(self) -> list[str]:
        return list(self._lines)[-SHOWN_LINES:]

    def start(self, stage: str, work: Callable[[], object]) -> bool:
        """False if another stage runs. Spark jobs of the stage form one group, so they can be told apart."""
        with self._lock:
            if self._stage:
                return False
            self._stage = stage

        def run() -> None:
            try:
                self.spark.sparkContext.setJobGroup(stage, stage, True)
                self.log(f"{stage}: started")
                self.log(f"{stage}: done ({work()})")
            except Exception as error:
                self.log(f"{stage}: failed: {error}")
            finally:
                self._stage = None

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()
        return True

    def wait(self) -> None:
        if self._thread:
            self._thread.join()


def status_counts(cache: DataFrame, raw: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: cached texts, extraction results and verdict results so far."""
    counts = [
        t.agg(F.count(F.lit(1)).alias(n)) for t,
        n in ((cache.where("coalesce(text, '') <> ''"), "cached"), (raw, "extracted"), (verdicts, "verified"))
    ]
    return counts[0].join(counts[1]).join(counts[2])
