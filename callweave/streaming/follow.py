"""Keep an index in step with a stream of change notices. An extension.

The stream is keyed by file, and what a file last was is state. A notice re-reads the file that it names and no other;
if that is what it was, nothing follows. What has changed in a micro-batch is parsed and becomes one change of the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from callweave.engine import Engine
from callweave.sources import scan, workspace

#: What transformWithState keeps its state in.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEEN = f"{workspace.SCHEMA}, gone boolean"


class LastSeen(StatefulProcessor):
    """Of each file: the hash of its text when it was last read; none once it is gone."""

    def __init__(self, folder: str, include_library: bool):
        self.folder, self.include_library = folder, include_library

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string, modified long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:  # however many notices there are of the file, it is read once
            pass
        (path,) = key
        if path is None:
            return
        found = workspace.one_file(self.folder, path, self.include_library)
        if found is None:
            self.last.clear()
            yield self._row((path, None, None, None, None, None, None), True)
            return
        text = workspace.text_of(self.folder, path)
        if text is None:  # not UTF-8 at present: the index keeps what it has
            return
        now = (hashlib.md5(text.encode()).hexdigest(), found[3])
        if self.last.exists() and tuple(self.last.get()) == now:
            return
        self.last.update(now)
        yield self._row((*found, scan.is_test_path(path), text, now[0]), False)

    def _row(self, values: tuple, gone: bool) -> pd.DataFrame:
        return pd.DataFrame([(*values, gone)], columns=[c.split()[0] for c in SEEN.split(", ")]).astype({"size_bytes": "Int64", "last_modified": "Int64", "is_test": "boolean"})

    def close(self) -> None:
        pass


def follow(notices: DataFrame, engine: Engine, checkpoint: str, include_library: bool = False) -> StreamingQuery:
    """Apply what ``notices`` (file_path; other columns are ignored) say, a change of the index for each micro-batch.

    The index must have been built. A notice of a file that is gone takes it from the index; of one that isn't source,
    or can't be read, nothing. State and the offsets of the notices are in ``checkpoint``; a batch that is run again
    after a failure finds its change made already, as what the index has of a file is compared before it is replaced.
    """
    engine.spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    seen = notices.select("file_path").groupBy("file_path").transformWithStateInPandas(LastSeen(engine.workspace, include_library), SEEN, "Append", "None")

    def on_batch(batch: DataFrame, _: int) -> None:
        engine.apply(batch)

    return seen.writeStream.foreachBatch(on_batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
