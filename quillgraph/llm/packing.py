"""Shuffles of packed numpy records, hashed counts and shared scratch space.

Operators that would move tens of millions of small records send them as byte blocks:
each map task sorts its records by destination and emits one block per destination, so
that neither the JVM nor Python touches single records. Destinations are as many as
``spark.sql.shuffle.partitions``; no record is dropped and no task sees the whole corpus.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_SCHEMA = "dest int, payload binary"
FLUSH_BYTES = 24 << 20


def shuffle_width(spark: SparkSession) -> int:
    """How many destinations a packed shuffle has."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def use_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() write to the folder that the cluster names in spark.checkpoint.dir.

    Only where that setting and the context's folder are both absent (tests on one machine)
    a temporary folder is taken.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from shared storage, with the lineage cut."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a name like it that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    return wanted if wanted.lower() not in taken else f"{wanted}_{uuid.uuid4().hex[:8]}"


class Shared:
    """A broadcast value that may hold objects of this package, which executors needn't have installed."""

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __getstate__(self):
        return {"_sent": self._sent}

    @property
    def value(self):
        if "_loaded" not in self.__dict__:
            self._loaded = pickle.loads(self._sent.value)
        return self._loaded

    def drop(self) -> None:
        """Free the value's copies where nothing will ask for it again."""
        self._sent.destroy()


class Router:
    """Gathers records of one numpy dtype for destinations 0..n-1 and emits them as blocks."""

    def __init__(self, n: int, limit: int = FLUSH_BYTES):
        self.n, self.limit, self.size = n, limit, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, dest: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(records):
            self.parts.append((dest.astype(np.int32), records))
            self.size += records.nbytes
            if self.size >= self.limit:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        dest = np.concatenate([d for d, _ in self.parts])
        records = np.concatenate([r for _, r in self.parts])
        self.parts, self.size = [], 0
        order = np.argsort(dest.astype(np.uint16) if self.n <= 1 << 16 else dest, kind="stable")
        records = np.ascontiguousarray(records[order])
        counts = np.bincount(dest, minlength=self.n)
        live = np.flatnonzero(counts)
        ends = np.cumsum(counts)[live] * records.dtype.itemsize
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        payload = pa.Array.from_buffers(pa.binary(), len(live), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(records.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), payload], ["dest", "payload"])


def unpacked(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> np.ndarray:
    """All records of the blocks of a partition."""
    parts = []
    for batch in batches:
        column = batch.column("payload").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        if len(column) and offsets[-1] > offsets[0]:
            parts.append(np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy())
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)).view(dtype)


def exchanged(blocks: DataFrame, width: int) -> DataFrame:
    """Blocks at the partition that ``dest`` numbers."""
    return blocks.repartitionById(width, F.col("dest"))


def hashed_totals(df: DataFrame, slots: int, count: Callable[[pa.RecordBatch, np.ndarray], None], reducers: int = 8) -> np.ndarray:
    """Sums, over all rows, of what ``count(batch, totals)`` adds to a table of ``slots`` int64.

    The table is of a fixed size, whatever the data: each task adds up its own, sends the
    slots that it used, and ``reducers`` tasks add up ranges of slots. The driver gets
    8 * slots bytes.
    """
    record = np.dtype([("slot", "<u4"), ("n", "<i8")])
    span = -(-slots // reducers)

    def count_task(batches):
        totals = np.zeros(slots, np.int64)
        for batch in batches:
            count(batch, totals)
        used = np.flatnonzero(totals)
        records = np.empty(len(used), record)
        records["slot"], records["n"] = used, totals[used]
        router = Router(reducers)
        yield from router.add(used // span, records)
        yield from router.flush()

    def add_task(batches):
        totals, first = np.zeros(span, np.int64), None
        for batch in batches:
            for dest in range(len(batch)):
                number = batch.column("dest")[dest].as_py()
                first = number if first is None else first
                records = unpacked(iter([batch.slice(dest, 1)]), record)
                totals[records["slot"].astype(np.int64) - number * span] += records["n"]
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([totals.tobytes()], pa.binary())], ["dest", "payload"])

    blocks = df.mapInArrow(count_task, BLOCK_SCHEMA)
    rows = exchanged(blocks, reducers).mapInArrow(add_task, BLOCK_SCHEMA).collect()
    totals = np.zeros(span * reducers, np.int64)
    for row in rows:
        totals[row["dest"] * span : (row["dest"] + 1) * span] = np.frombuffer(row["payload"], np.int64)
    return totals[:slots]
