"""Firing on the executors: a stateful operator keyed by callback.

Arrivals (array_name, timestep, seq) are joined with the small table of subscriptions, so that one key
sees all arrays of a callback, and sorted by seq in a batch, as shuffles lose the order. State holds
timesteps, not cells; whoever needs them joins the firings with the chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from meshflow.streaming.machine import TriggerMachine

FIRINGS = "callback_id string, seq bigint, kind string, array_name string, timestep bigint, windows string"
SUBSCRIPTIONS = "callback_id string, ordinal int, array_name string, window_size int, `when` string"


def with_state_store(spark: SparkSession) -> SparkSession:
    """Sets the state store that stateful operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _step(machine: TriggerMachine, rows: pd.DataFrame, key: str) -> pd.DataFrame:
    out = []
    for r in rows.itertuples(index=False):
        said = machine.arrive(r.array_name, int(r.timestep))
        if said:
            shown = "|".join(",".join(map(str, w)) for w in said[1]) if said[0] == "fire" else said[1]
            out.append((key, int(r.seq), said[0], r.array_name, int(r.timestep), shown))
    return pd.DataFrame(out, columns=["callback_id", "seq", "kind", "array_name", "timestep", "windows"])


class FiringProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", "m string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        held = self.state.get()
        if held is None or held[0] is None:
            spec = [s.rsplit(":", 1) for s in batch["spec"].iloc[0].split("|")]
            machine = TriggerMachine([(n, int(k)) for n, k in spec], batch["when"].iloc[0])
        else:
            machine = TriggerMachine.load(held[0])
        out = _step(machine, batch, key[0])
        self.state.update((machine.dump(),))
        yield out

    def close(self) -> None:
        pass


def fire(arrivals: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Firings and late arrivals (FIRINGS) of each callback; arrivals: a stream of array_name, timestep, seq."""
    entry = F.concat_ws(":", "array_name", "window_size")
    spec = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", entry.alias("e")))), lambda x: x["e"]), "|")
    whole = subscriptions.groupBy("callback_id", "when").agg(spec.alias("spec"), F.collect_set("array_name").alias("names"))
    own = whole.select("callback_id", "when", "spec", F.explode("names").alias("array_name"))
    keyed = arrivals.select("array_name", "timestep", "seq").join(F.broadcast(own), "array_name")
    return keyed.groupBy("callback_id").transformWithStateInPandas(FiringProcessor(), FIRINGS, "Append", "None")
