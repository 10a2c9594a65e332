"""One fold, two hosts: a keyed state machine runs over a table or over a stream.

A machine turns (state, row) into output rows; its state is a JSON-able dict, so that the
stream host can keep it between micro-batches and both hosts give the same rows. Spark
groups the rows by key; only one key's rows are folded at a time, in order of time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


class Machine:
    """``start`` makes the state of a new key, ``step`` folds a row in, ``finish`` closes what is open."""

    columns: tuple[str, ...] = ()

    def start(self) -> dict:
        return {}

    def step(self, state: dict, row: dict) -> list[dict]:
        raise NotImplementedError

    def finish(self, state: dict) -> list[dict]:
        return []


def _frame(key: dict, out: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([key | x for x in out], columns=names)


def run_batch(rows: DataFrame, machine: Machine, keys: list[str], order: list[str], schema: str, close: bool = True) -> DataFrame:
    """All rows of each key through the machine, then ``finish`` unless ``close`` is off.

    Rows come sorted and batch by batch; only the state of one key is held at a time.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def fold(batches):
        key, state = None, None

        def ended() -> list[dict]:
            return [dict(zip(keys, key)) | x for x in machine.finish(state)] if close and key is not None else []

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                mine = tuple(row[k] for k in keys)
                if mine != key:
                    out += ended()
                    key, state = mine, machine.start()
                out += [dict(zip(keys, key)) | x for x in machine.step(state, row)]
            yield from pa.Table.from_pylist(out, schema=kinds).to_batches()
        yield from pa.Table.from_pylist(ended(), schema=kinds).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(fold, schema)


class _Host(StatefulProcessor):
    def __init__(self, machine: Machine, keys: list[str], order: list[str], names: list[str]):
        self.machine, self.keys, self.order, self.names = machine, keys, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timer_values) -> Iterable[pd.DataFrame]:
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else self.machine.start()
        pdf, out = pd.concat(list(rows)).sort_values(self.order, kind="stable"), []
        for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
            out += self.machine.step(state, row)
        self.kept.update((json.dumps(state, default=float),))
        yield _frame(dict(zip(self.keys, key)), out, self.names)

    def close(self) -> None:
        pass


def run_stream(rows: DataFrame, machine: Machine, keys: list[str], order: list[str], schema: str) -> DataFrame:
    """The same over a stream; what is open at a batch's end stays open. Needs the RocksDB state store."""
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=_Host(machine, keys, order, names), outputStructType=schema, outputMode="Append", timeMode="None")
