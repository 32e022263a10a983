"""Rules over event time: rows in order however they arrive, what falls due without a row, state that ends.

A rule is written once.  In batch it runs over sorted partitions, cut where a key is silent for
longer than the rule remembers.  In a stream the rows of a key wait until the watermark has passed
them; a timer then takes them in order, runs what fell due between them and after them, and drops
the state of a key that has ended.  Keys are dealt to buckets, and a call of Spark is for a bucket.
Rows later than the watermark are left out, as anywhere in a stream.  Times are whole numbers of
milliseconds (or frames).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..functions.ordered import fold_sorted, index_block, islands

#: State is kept in RocksDB, that of a join in one store a partition instead of four; rows are not counted, which costs a
#: read for each write, and files are not made larger ahead (some 10 MB a store, however little it holds).
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
#: Buckets that the keys of a stream are dealt to; part of a checkpoint, so it stays.
BUCKETS = 1024
#: Rows of a bucket that are Python objects at a time.
ROWS = 10_000


class Rule:
    """What a key remembers, does with the rows of one moment, and does by itself.

    The state is a dict that JSON can hold.  ``until`` in it is the last moment of the key unless
    more rows come; a row after it finds a new key.
    """

    def start(self, t: int) -> dict:
        raise NotImplementedError

    def take(self, state: dict, t: int, rows: list[dict]) -> list[tuple]:
        """The rows of moment t; sets ``until``."""
        raise NotImplementedError

    def run(self, state: dict, upto: int) -> list[tuple]:
        """What falls due up to and with that moment, after what was run before."""
        return []


def advance(rule: Rule, state: dict | None, rows: list[dict], upto: int | None) -> tuple[dict | None, list[tuple]]:
    """Take rows (all up to ``upto``) in order of time and run to that moment, or to the key's end."""
    out: list[tuple] = []
    rows = sorted(rows, key=lambda r: r["t"])
    at = 0
    while at < len(rows):
        t, begin = rows[at]["t"], at
        while at < len(rows) and rows[at]["t"] == t:
            at += 1
        if state is not None:
            out += rule.run(state, min(t - 1, state["until"]))
            if state["until"] < t:
                state = None
        if state is None:
            state = rule.start(t)
        out += rule.take(state, t, rows[begin:at])
    if state is not None:
        end = state["until"] if upto is None else min(upto, state["until"])
        out += rule.run(state, end)
        if upto is None or state["until"] <= upto:
            state = None
    return state, out


def _plain(v):
    """Values as JSON has them."""
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return None if v is pd.NaT or v != v else v


class _Processor(StatefulProcessor):
    """Rows of a bucket of keys wait as Arrow batches in a list state until a timer finds that the watermark has passed them.

    A call costs milliseconds and a row microseconds, so what is called for is a bucket, not a key.
    """

    def __init__(self, rule: Rule, keys: list[str], columns: list[str], given: list[str], schema: pa.Schema, names: list[str]):
        self.rule, self.keys, self.columns, self.given, self.schema, self.names = rule, keys, columns, given, schema, names

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "states string")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.done: set[tuple] = set()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            pdf.columns = self.given
            batch = pa.RecordBatch.from_pandas(pdf[self.schema.names], self.schema, preserve_index=False)
            self.waiting.appendValue((_packed(batch),))
            t = int(pdf["t"].min())
            first = t if first is None else min(first, t)
        if first is not None:
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key in self.done:  # the first of several timers that have passed does it all
            return
        self.done.add(key)
        upto = timerValues.getCurrentWatermarkInMs()
        held = {tuple(k): state for k, state in json.loads(self.kept.get()[0])} if self.kept.exists() else {}
        rows, later = self.ready(upto)
        live: list[tuple] = []
        out: list[tuple] = []
        for own, moments in groupby(_moments(rows, self.keys, self.columns), key=lambda m: m[0]):
            state = held.pop(own, None)
            for _, _, moment in moments:
                state, new = _moment(self.rule, state, moment)
                out += [(*own, *r) for r in new]
                if len(out) >= ROWS:
                    yield self.frame(out)
                    out = []
            held[own] = state
        for own, state in held.items():
            state, new = advance(self.rule, state, [], upto)
            out += [(*own, *r) for r in new]
            if len(out) >= ROWS:
                yield self.frame(out)
                out = []
            if state is not None:
                live.append((own, state))
        if out:
            yield self.frame(out)
        if live:
            self.kept.update((json.dumps(live),))
            # nothing falls due before the moment after this one; the rule looks at all of it then
            self.handle.registerTimer(upto + 1)
        else:
            self.kept.clear()
        if later is not None:
            self.handle.registerTimer(later)

    def ready(self, upto: int) -> tuple[pa.Table, int | None]:
        """Takes the rows up to that moment out of the list; with them, the time of the first one left."""
        batches = [pa.ipc.read_record_batch(pa.py_buffer(bytes(r[0])), self.schema) for r in self.waiting.get()] if self.waiting.exists() else []
        ready, later, first = [], [], None
        for batch in batches:
            t = batch.column("t").to_numpy()
            past = t <= upto
            if past.any():
                ready.append(batch if past.all() else batch.filter(pa.array(past)))
            if not past.all():
                later.append(batch if not past.any() else batch.filter(pa.array(~past)))
                first = min([int(t[~past].min())] + ([first] if first is not None else []))
        if ready and later:
            whole = pa.Table.from_batches(later, self.schema).combine_chunks()
            self.waiting.put([(_packed(b),) for b in whole.to_batches(max_chunksize=ROWS)])
        elif ready:
            self.waiting.clear()
        return pa.Table.from_batches(ready, self.schema).combine_chunks(), first

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.names).astype(object)

    def close(self) -> None:
        pass


def _packed(batch: pa.RecordBatch) -> bytes:
    return batch.serialize().to_pybytes()


def _values(column: pa.Array) -> list:
    """Values as JSON has them."""
    kind = column.type
    if column.null_count or not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return _plain(column.to_pylist())
    got = column.to_numpy(zero_copy_only=False)
    return _plain(got) if pa.types.is_floating(kind) and np.isnan(got).any() else got.tolist()


def _moments(table: pa.Table, keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, int, list[dict]]]:
    """Keys, time and rows of each moment, the moments of a key one after the other in order of time.

    Rows of one moment stay in the order in which they came; ROWS of them are Python objects at a time.
    """
    if not len(table):
        return
    codes = [pd.factorize(table.column(k).to_pandas(), use_na_sentinel=False)[0] for k in reversed(keys)]
    order = np.lexsort([table.column("t").to_numpy(), *codes])
    at, now = None, []
    for begin in range(0, len(order), ROWS):
        part = table.take(pa.array(order[begin : begin + ROWS])).combine_chunks()
        lists = {c: _values(part.column(c).combine_chunks()) for c in part.column_names}
        for own, t, row in zip(zip(*(lists[k] for k in keys)), lists["t"], zip(*(lists[c] for c in columns))):
            if (own, t) != at:
                if now:
                    yield (*at, now)
                at, now = (own, t), []
            now.append(dict(zip(columns, row)))
    yield (*at, now)


def by_event_time(stream: DataFrame, keys: list[str], time: str, rule: Rule, schema: str) -> DataFrame:
    """Run a rule over a stream with a watermark.

    ``time`` is a timestamp column of whole milliseconds after 1970 (where a watermark starts, so an
    earlier row is late); the rule sees it as ``t`` and the other columns by their names.
    ``schema`` starts with the keys, which are numbers or texts.
    """
    for name, value in STATE.items():
        stream.sparkSession.conf.set(name, value)
    d = stream.withColumn("t", F.unix_millis(time))
    columns = [c for c in d.columns if c not in (*keys, time)]
    d = d.select(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket_of_keys"), time, *keys, *columns)
    processor = _Processor(rule, keys, columns, d.columns, to_arrow_schema(d.select(*keys, *columns).schema), StructType.fromDDL(schema).names)
    return d.groupBy("bucket_of_keys").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def in_batch(df: DataFrame, keys: list[str], rule: Rule, schema: str, silence: int) -> DataFrame:
    """Run a rule over a table with a time column ``t`` (long).

    A key is cut where it is silent for longer than ``silence``, which must be at least what the
    rule remembers after a row, so a long key is many tasks.
    """
    d = islands(df, keys, ["t"], index_block("t", 60_000), ["t"], lambda p, c: c["t"] - p["t"] > silence, "_part")
    cols = [c for c in df.columns if c not in keys]
    at = [d.columns.index(c) for c in cols]
    own = [d.columns.index(k) for k in keys]
    t_at = d.columns.index("t")

    def step(held, row):
        key = tuple(row[i] for i in own)
        state, pending, _ = held
        out: list[tuple] = []
        if pending and pending[0]["t"] != row[t_at]:
            state, out = _moment(rule, state, pending)
            pending = []
        pending = [*pending, dict(zip(cols, (_plain(row[i]) for i in at)))]
        return (state, pending, key), [(*key, *r) for r in out]

    def finish(held):
        state, pending, key = held
        out: list[tuple] = []
        if pending:
            state, out = _moment(rule, state, pending)
        _, more = advance(rule, state, [], None)
        return [(*key, *r) for r in [*out, *more]]

    return fold_sorted(d, [*keys, "_part"], ["t"], schema, lambda: (None, [], ()), step, finish)


def _moment(rule: Rule, state: dict | None, rows: list[dict]) -> tuple[dict | None, list[tuple]]:
    """Take the rows of one moment and nothing that falls due at it or later."""
    t, out = rows[0]["t"], []
    if state is not None:
        out = rule.run(state, min(t - 1, state["until"]))
        if state["until"] < t:
            state = None
    state = rule.start(t) if state is None else state
    return state, [*out, *rule.take(state, t, rows)]


def run_closed(spark: SparkSession, build: Callable[[DataFrame], DataFrame], name: str, far: str = "2200-01-01") -> DataFrame:
    """Run a stream over everything that is there and then to the end of time; returns the rows written.

    ``build`` gets a stream of one timestamp column ``closing`` that it puts beside its own rows, as
    a row of a key that is dropped later and that no filter before the watermark takes away.  It has
    no rows in the first run; the second run, on the same checkpoint, has one row far ahead, so that
    the watermark passes all rows that wait.
    """
    from .streams import shared_folder

    root = shared_folder(spark, name)
    clock = f"{root}/clock"
    spark.createDataFrame([], "closing timestamp").write.parquet(clock)
    result = build(spark.readStream.schema("closing timestamp").parquet(clock))
    idle = spark.conf.get(NO_DATA)
    for last in (False, True):
        if last:
            spark.sql(f"SELECT timestamp'{far}' AS closing").write.mode("append").parquet(clock)
        out = result.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint")
        out = out.format("parquet").option("path", f"{root}/data")
        try:
            # what the watermark passes with the last rows of the first run is taken in the batch of the closing row, not in one of its own
            spark.conf.set(NO_DATA, idle if last else "false")
            running = out.start()
        finally:
            spark.conf.set(NO_DATA, idle)
        running.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{root}/data")
