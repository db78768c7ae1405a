"""Review marks in a state store: the latest mark of each domain is kept by key, and a batch writes what it has changed and nothing else.

A mark replaces the one before if it was made later, or at the same time with a larger ``seq``; a late or repeated mark changes nothing.
The state survives restarts with the checkpoint, and the file sink drops a batch that ran twice. The changes of all batches are the table's
history; its current rows are the last change of each domain (:func:`current`). What machines compute never writes here, so no re-run
of a stage can touch a mark. A null domain is a key like any other; a null time counts as before all others.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from leadforge.operators.report import latest

MARKS = "domain string, human_tier string, pitch boolean, note string, reviewed_at string, seq bigint"
COLUMNS = ["domain", "human_tier", "pitch", "note", "reviewed_at", "seq"]
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def order_of(mark: tuple) -> tuple[str, int]:
    """What decides between two marks of a domain."""
    return mark[3] or "", -1 if mark[4] is None else int(mark[4])


class LatestMark(StatefulProcessor):
    """Holds one mark for each key and passes on a mark that replaces it. Rows come as rows: a frame for each domain costs more than its few marks."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "human_tier string, pitch boolean, note string, reviewed_at string, seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.mark.get()
        best = tuple(held) if held is not None else None
        changed = False
        for row in rows:
            mark = tuple(row)[1:]
            if best is None or order_of(mark) > order_of(best):
                best, changed = mark, True
        if changed:
            self.mark.update(best)
            yield Row(**dict(zip(COLUMNS, (key[0], *best))))

    def close(self) -> None:
        pass


def keep_marks(marks: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Works through what is new in a stream of marks and stops; ``table`` gets the changes of each batch."""
    marks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    changes = marks.select(*COLUMNS).groupBy("domain").transformWithState(LatestMark(), MARKS, "Append", "None")
    return changes.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mark_files(spark: SparkSession, source: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of JSON files of marks, in the order in which they came."""
    return spark.readStream.schema(MARKS).option("maxFilesPerTrigger", files_per_batch).json(source)


def current(spark: SparkSession, table: str) -> DataFrame:
    """The last change of each domain."""
    return latest(spark.read.schema(MARKS).parquet(table), "domain", "reviewed_at", "seq")
