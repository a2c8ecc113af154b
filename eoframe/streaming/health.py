"""Live service health: the same step rule as the batch replay, with the state of a service kept between batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eoframe.config import HealthConfig
from eoframe.operators.health import DECISION, FAR, replay, typed_calls, with_nulls
from eoframe.streaming.runtime import needs_rocksdb


class ServiceHealth(StatefulProcessor):
    """Constant state per service. Calls of one batch are taken in event-time order; across batches arrival decides,
    as it does for the live rule."""

    def __init__(self, limit: int, pause: int):
        self.limit, self.pause = limit, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("health", "state int, since bigint")

    def handleInputRows(self, key, rows, timerValues):
        state, since = tuple(self.state.get()) if self.state.exists() else (0, 0)
        batch = pd.concat(list(rows)).sort_values(["no_ts", "ts_ms", "no_id", "event_id"], ignore_index=True)
        batch["ts_ms"] = np.where(batch["no_ts"], FAR + np.arange(len(batch)) * self.pause, batch["ts_ms"])
        out, state, since = replay(batch, state, since, self.limit, self.pause)
        self.state.update((state, -FAR if since >= FAR else since))  # opened at no time: whatever comes next is after the pause
        yield out.assign(no_id=batch["no_id"])

    def close(self) -> None:
        pass


def health_stream(calls: DataFrame, cfg: HealthConfig | None = None) -> DataFrame:
    cfg = cfg or HealthConfig()
    needs_rocksdb(calls.sparkSession)
    decided = typed_calls(calls).groupBy("service").transformWithStateInPandas(
        statefulProcessor=ServiceHealth(cfg.failure_threshold, cfg.recovery_ms), outputStructType=f"{DECISION}, no_id boolean",
        outputMode="Append", timeMode="None",
    )
    return with_nulls(decided)
