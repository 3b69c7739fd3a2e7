"""Training runs followed from their events: where each may be taken up again, and what it has seen.

An event has run, kind and the fields of its kind:

* ``start``: identity, the digest of what the run is (config, dataset, ranks);
* ``checkpoint``: step, folder and complete;
* ``reward``: id, positive and reward of a scored completion.

State lives in the stream's store, keyed by run: the identity, the last complete
step and its folders, counts, and the least and the greatest reward of each id.
A restarted stream goes on from its checkpoint; nothing is read again. The same
processor runs over a table of events at once.

Defined results: a run whose start has another identity than its first is
``refused`` from then on, and keeps what it had; two complete folders for the
last step make it ``ambiguous``; events of no known kind, and those without a
step or an id, count for nothing; a null run is a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What state stores need for lists and maps by key.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EVENT = "run string, kind string, identity string, step long, folder string, complete boolean, id string, positive boolean, reward double"
SEEN = "run string, identity string, step long, status string, rewards long, positive boolean, negative boolean, uneven_ids long"
#: Two rewards of one id differ if they lie further apart.
EVEN = 1e-8


class Follower(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "identity string, refused boolean, step long, rewards long, positive boolean, negative boolean, uneven_ids long")
        self.folders = handle.getMapState("folders", "folder string", "step long")
        self.spans = handle.getMapState("spans", "id string", "low double, high double")

    def _start(self, seen: dict[str, Any], event: Any) -> None:
        if pd.notna(event.identity):
            seen["identity"] = seen["identity"] or event.identity
            seen["refused"] |= seen["identity"] != event.identity

    def _checkpoint(self, seen: dict[str, Any], event: Any) -> None:
        if pd.isna(event.step) or not (pd.notna(event.complete) and event.complete) or (seen["step"] is not None and event.step < seen["step"]):
            return
        if event.step != seen["step"]:
            self.folders.clear()
            seen["step"] = int(event.step)
        self.folders.updateValue((str(event.folder),), (seen["step"],))

    def _reward(self, seen: dict[str, Any], event: Any) -> None:
        if pd.isna(event.id) or pd.isna(event.reward):
            return
        seen["rewards"] += 1
        seen["positive"] |= bool(pd.notna(event.positive) and event.positive)
        seen["negative"] |= bool(pd.notna(event.positive) and not event.positive)
        low, high = self.spans.getValue((event.id,)) if self.spans.containsKey((event.id,)) else (event.reward, event.reward)
        was, low, high = high - low > EVEN, min(low, event.reward), max(high, event.reward)
        seen["uneven_ids"] += (high - low > EVEN) - was
        self.spans.updateValue((event.id,), (float(low), float(high)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = ("identity", "refused", "step", "rewards", "positive", "negative", "uneven_ids")
        seen = dict(zip(names, self.run.get() if self.run.exists() else (None, False, None, 0, False, False, 0), strict=True))
        of_kind = {"start": self._start, "checkpoint": self._checkpoint, "reward": self._reward}
        for batch in rows:
            for event in batch.itertuples(index=False):
                if event.kind in of_kind:
                    of_kind[event.kind](seen, event)
        self.run.update(tuple(seen[n] for n in names))
        folders = sum(1 for _ in self.folders.keys())
        status = "refused" if seen["refused"] else "ambiguous" if folders > 1 else "open" if seen["step"] is None else "ready"
        told = {"run": key[0], "identity": seen["identity"], "step": seen["step"], "status": status, **{n: seen[n] for n in names[3:]}}
        yield pd.DataFrame([told]).astype({"step": "Int64"})

    def close(self) -> None:
        pass


def follow(events: DataFrame) -> DataFrame:
    """What is known of every run that has new events: the last complete step, whether the run can go on from there, and what its rewards told. ``events``: a stream or a table."""
    spark = events.sparkSession
    spark.conf.set(*STORE)
    spark.streams.active  # noqa: B018  state stores, a table's too, report to what this starts
    return events.groupBy("run").transformWithStateInPandas(Follower(), SEEN, "Update", "None")
