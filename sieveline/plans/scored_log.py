"""A score that follows a log of verdicts: each append changes the sums of its own papers alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import score
from ..sources.log import Log
from ..tables import stored

SUMS = "paper_id string, " + ", ".join(f"{c} {'decimal(28,4)' if c in ('points', 'weight') else 'long'}" for c in score.SUMS) + ", upto long"


class ScoredLog:
    """Verdicts, the last row of a key counts, and beside them the sums of each paper, a log of their own.

    An append writes the delta and the new sums of the papers that it names. Papers that were not there before have
    their sums from the delta; of others the verdicts so far are read again, and of no other paper. The score adds up
    a row a paper. If a run is lost between both writes, the sums lack the last versions; the next call makes them up.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, *key: str) -> None:
        if "paper_id" not in key:
            raise ValueError("paper_id has to be part of the key")
        self.spark = spark
        self.verdicts = Log(spark, f"{folder}/verdicts", schema, *key)
        self.sums = Log(spark, f"{folder}/sums", SUMS, "paper_id")

    def _upto(self) -> int:
        """The version of the verdicts that the sums hold."""
        return self.sums.state().agg({"upto": "max"}).first()[0] or 0

    def _followed(self, delta: DataFrame, upto: int) -> None:
        papers = stored(delta.select("paper_id").distinct(), "scored-papers")
        known = stored(self.sums.state().select("paper_id").join(papers, "paper_id", "left_semi"), "scored-known")
        if known.isEmpty():
            rows = self.verdicts.last(delta)
        else:  # rows of papers that were there, with those they replace; of new ones the delta has all
            new = self.verdicts.last(delta).join(known, "paper_id", "left_anti")
            rows = self.verdicts.state_of(known).unionByName(new)
        found = score.paper_sums(rows).selectExpr("*", f"CAST({upto} AS LONG) AS upto")
        self.sums.append(found)

    def append(self, rows: DataFrame) -> int:
        self.catch_up()
        version = self.verdicts.append(rows)
        self._followed(self.verdicts.added(version - 1), version)
        return version

    def catch_up(self) -> None:
        """Sums of versions that were published without them."""
        have, now = self._upto(), self.verdicts.version()
        if have < now:
            self._followed(self.verdicts.added(have), now)

    def score(self) -> DataFrame:
        """The row of ``score.reliability`` on the state of the verdicts."""
        self.catch_up()
        return score.from_sums(self.sums.state())
