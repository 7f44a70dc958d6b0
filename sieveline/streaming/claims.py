"""Claims of papers over arriving files: what a batch changes, and a log that ends as ``settle_claims`` would have it.

Of the files that claim a paper, in the files' order, those count that beat every earlier one: the last of them is
matched, the others are superseded, all else is a duplicate. A file that arrives can only change these, so they are
all that is kept of a paper: one for each different confidence at most, however many files claim it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.log import Log
from ..tables import dropped, stored

MATCHES = "file string, paper_id string, match_method string, confidence double, status string"
CHAIN = "file string, match_method string, confidence double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Claims(StatefulProcessor):
    """The chain of a paper's files that beat all earlier ones; emits each claim whose status is new or has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chain = handle.getListState("chain", CHAIN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = [tuple(r) for r in self.chain.get()]
        chain, status = list(before), {}
        for r in rows:
            status |= settled(chain, r.file, r.match_method, float(r.confidence))
        state = {row: "superseded" for row in chain[:-1]} | {chain[-1]: "matched"}
        was = {row: "superseded" for row in before[:-1]} | ({before[-1]: "matched"} if before else {})
        status |= {row: now for row, now in state.items() if was.get(row) != now}
        if chain != before:
            self.chain.put(chain)
        for (file, method, confidence), now in status.items():
            yield Row(file=file, paper_id=key[0], match_method=method, confidence=confidence, status=now)

    def close(self) -> None:
        pass


def settled(chain: list[tuple], file: str, method: str, confidence: float) -> dict[tuple, str]:
    """Puts a file into a chain in file order, or not; those that are no part of it any more are duplicates."""
    own, place = (file, method, confidence), file.split("/")
    if any(c[2] >= confidence and c[0] != file and c[0].split("/") <= place for c in chain):
        return {own: "duplicate_match"}
    lost = [c for c in chain if c[0] != file and c[0].split("/") > place and c[2] <= confidence]
    kept = [c for c in chain if c not in lost and c[0] != file]
    chain[:] = sorted([*kept, own], key=lambda c: c[0].split("/"))
    return dict.fromkeys(lost, "duplicate_match")


def changed_claims(matches: DataFrame) -> DataFrame:
    """Of a stream of MATCHES rows (``match_files`` makes them) the claims of each batch that are new or have changed.

    Files without a paper pass as they are. A file that comes again, as it was, changes nothing.
    """
    spark = matches.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    found = matches.where("status = 'matched'").groupBy("paper_id").transformWithState(Claims(), MATCHES, "Update", "None")
    return found.unionByName(matches.where("status <> 'matched'").select(*found.columns))


def claims_log(spark: SparkSession, folder: str) -> Log:
    return Log(spark, folder, MATCHES, "file")


def follow(matches: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Takes in all that is there now and stops; the log in ``folder`` has the claims so far. A batch that is repeated changes nothing."""

    def keep(batch: DataFrame, number: int) -> None:
        changed = stored(batch, "claims-changed")  # a batch is run by each look at it, its state with it
        if not changed.isEmpty():
            claims_log(batch.sparkSession, folder).append(changed)
        dropped(changed)

    stream = changed_claims(matches).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return stream.foreachBatch(keep).trigger(availableNow=True).start()
