"""Worker events as streams (STR01, STR03, STR06, STR08, UDF05, H8).

State is a few values a run in the state store; a processing-time timer reports runs that fall silent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "run_id string, sequence long, type string, problem string"
_TERMINAL = ("completed", "failed")


class EventValidator(StatefulProcessor):
    """The protocol's order rules for each run: sequences grow, time does not go back, one start, nothing after the end."""

    def __init__(self, silence_ms: int = 0):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "sequence long, time timestamp, ended boolean, dedup string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get() if self.state.exists() else (0, None, False, None)
        last, begun = list(last), self.state.exists()
        out = []
        for frame in rows:
            for r in frame.sort_values("line_no").itertuples():
                problem = None
                if last[2]:
                    problem = "after_terminal"
                elif not begun and r.type != "started":
                    problem = "first_not_started"
                elif begun and r.type == "started":
                    problem = "started_again"
                elif r.sequence <= last[0]:
                    problem = "sequence_not_increasing"
                elif last[1] is not None and r.time < last[1]:
                    problem = "time_backwards"
                out.append((key[0], int(r.sequence), r.type, problem))
                begun = True
                last = [max(last[0], int(r.sequence)), r.time if last[1] is None else max(last[1], r.time), last[2] or r.type in _TERMINAL, last[3]]
        self.state.update(tuple(last))
        if self.silence_ms and not last[2]:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence_ms)
        yield pd.DataFrame(out, columns=["run_id", "sequence", "type", "problem"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """STR06: a run that fell silent before its end."""
        yield pd.DataFrame([(key[0], None, None, "silent")], columns=["run_id", "sequence", "type", "problem"])

    def close(self) -> None:
        pass


def validate_stream(events: DataFrame, silence_ms: int = 0) -> DataFrame:
    """STR01: every event with the first rule it breaks; needs the RocksDB state store provider."""
    return events.groupBy("run_id").transformWithStateInPandas(
        EventValidator(silence_ms), OUTPUT, "Append", "ProcessingTime" if silence_ms else "None"
    )


def latest_progress(events: DataFrame) -> DataFrame:
    """STR04 on a stream (update mode)."""
    return events.where("type = 'progress'").groupBy("run_id").agg(F.max_by(F.struct("stage", "completed", "total"), "sequence").alias("progress"))


def on_completion(events: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str):
    """STR08, UDF05: each micro-batch goes to ``save``; batches may come in any order of chunks."""
    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).start()
