"""Rows that wait for their dimensions: a gate on a stream whose second input is the dimensions themselves."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

from ..operators.joins import all_there
from ..schemas import MACRO_ALIASES

#: What stands for fundamentals among the names of macro series.
FUNDAMENTALS = "fundamentals"
#: Slots that a ticker's rows are dealt to, the most rows and about the most bytes of a chunk of them, and the chunks that are given at a time.
SLOTS, CHUNK, CHUNK_BYTES, GIVEN = 16, 10_000, 1 << 18, 64


class UntilReady(StatefulProcessor):
    """Holds the chunks of a ticker's slot in a list until every required series and some fundamentals have been seen; then gives them in order of arrival, and later ones at once.

    Which dimensions have been seen is map state, so it and the list commit with the batch: a batch that fails after the release gives the same rows when it is run again.
    """

    def __init__(self, required: tuple[str, ...]):
        self.required = required

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "body binary")
        self.seen = handle.getMapState("seen", "name string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        new: list[bytes] = []
        for part in rows:
            dimension = part["body"].isna()
            for name in part["name"][dimension].unique().tolist():
                if not self.seen.containsKey((name,)):
                    self.seen.updateValue((name,), (1,))
            new += part["body"][~dimension].tolist()
        names = {k[0] for k in self.seen.keys()}
        if not all_there(names, FUNDAMENTALS in names, self.required):
            # One at a time: a list goes to the state as one message.
            for body in new:
                self.held.appendValue((body,))
            return
        old = [bytes(x[0]) for x in self.held.get()] if self.held.exists() else []
        self.held.clear()
        given = [(x, True) for x in old] + [(x, False) for x in new]
        for a in range(0, len(given), GIVEN):
            some = given[a : a + GIVEN]
            yield pd.DataFrame({"body": pd.Series([x for x, _ in some], dtype=object), "waited": [w for _, w in some]})

    def close(self) -> None:
        pass


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ticker, slot, name (null), body: the rows of a ticker, in order, as Arrow streams of bounded size."""
    for batch in batches:
        codes = batch.column("ticker").dictionary_encode("encode").indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        rows, ends = batch.take(pa.array(order)), np.flatnonzero(np.diff(codes[order], append=-1)) + 1
        firsts, bodies = [], []
        for first, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
            own = rows.slice(first, end - first)
            step = min(CHUNK, max(1, CHUNK_BYTES * len(own) // max(own.nbytes, 1)))
            for a in range(0, len(own), step):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, rows.schema) as stream:
                    stream.write_batch(own.slice(a, step))
                firsts.append(first)
                bodies.append(out.getvalue().to_pybytes())
        slots = pa.array([zlib.crc32(b) % SLOTS for b in bodies], pa.int32())
        made = [rows.column("ticker").take(pa.array(firsts, pa.int64())), slots, pa.nulls(len(bodies), pa.string()), pa.array(bodies, pa.binary())]
        yield pa.RecordBatch.from_arrays(made, ["ticker", "slot", "name", "body"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body, waited in zip(batch.column("body"), batch.column("waited")):
            for own in pa.ipc.open_stream(body.as_buffer()):
                yield pa.RecordBatch.from_arrays([*own.columns, pa.repeat(waited, len(own))], [*own.schema.names, "waited"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("name").unique()], ["name"])


def until_ready(rows: DataFrame, macro: DataFrame, fundamentals: DataFrame, tickers: DataFrame, required: tuple[str, ...] = MACRO_ALIASES) -> DataFrame:
    """`rows` (a stream with a ticker) with `waited`: those that came before all dimensions had are given once these are there, others as they come.

    macro (series) and fundamentals are streams too; what arrives there is told to each of `tickers`, a static dimension. Rows of tickers that it lacks, and of null ones, wait on. Macro rows of
    other series are not told. Rows wait in chunks that are dealt to SLOTS slots of their ticker, so a hot ticker is many tasks; all slots are told. Needs the RocksDB state store.
    """
    kind = StructType([StructField(f.name, f.dataType) for f in rows.schema])
    told = macro.filter(F.col("series").isin(*required)).select(F.col("series").alias("name")).unionByName(fundamentals.select(F.lit(FUNDAMENTALS).alias("name")))
    slots = tickers.select("ticker").distinct().select("ticker", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    dims = told.mapInArrow(_once, "name string").crossJoin(F.broadcast(slots)).select("ticker", "slot", "name", F.lit(None).cast("binary").alias("body"))
    chunk = StructType([kind["ticker"], StructField("slot", IntegerType()), StructField("name", StringType()), StructField("body", BinaryType())])
    given = rows.mapInArrow(_packed, chunk).unionByName(dims).groupBy("ticker", "slot").transformWithStateInPandas(UntilReady(required), "body binary, waited boolean", "Update", "None")
    return given.mapInArrow(_unpacked, StructType([*kind, StructField("waited", BooleanType())]))
