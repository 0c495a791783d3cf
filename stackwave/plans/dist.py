"""Building blocks that keep plans distributed: checkpoints, grouped streaming, micros.

Nothing here collects data to the driver; `grouped_map` keeps one group of a
partition in memory, so callers bound their groups (cells, salts, blocks).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone (read as UTC)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; set a folder only where none is set (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir", "")
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(configured or os.path.join(tempfile.gettempdir(), "stackwave-checkpoints"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the checkpoints, where all nodes reach it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _streamed(keys: Sequence[str], func: Callable, schema: pa.Schema) -> Callable:
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for k, part in _runs(batch, keys):
                if held and k != key:
                    yield from _out(func(key, pa.Table.from_batches(held)), schema)
                    held = []
                key = k
                held.append(part)
        if held:
            yield from _out(func(key, pa.Table.from_batches(held)), schema)

    return run


def starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """First row of each run of equal keys (null equals null)."""
    n = batch.num_rows
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for k in keys:
        c = batch.column(k)
        if n > 1:
            a, b = c.slice(1), c.slice(0, n - 1)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            change[1:] |= ~same.to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


def _runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    at, n = starts(batch, keys), batch.num_rows
    for i, j in zip(at, [*at[1:], n]):
        yield tuple(batch.column(k)[int(i)].as_py() for k in keys), batch.slice(int(i), int(j - i))


def _out(results, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for t in results:
        t = t if isinstance(t, pa.Table) else pa.Table.from_batches([t])
        yield from t.cast(schema).to_batches(max_chunksize=65536)


def _arrow_type(name: str) -> pa.DataType:
    name = name.strip()
    if name.startswith("array<"):
        return pa.list_(_arrow_type(name[6:-1]))
    simple = {"long": pa.int64, "int": pa.int32, "double": pa.float64, "float": pa.float32, "string": pa.string, "boolean": pa.bool_, "binary": pa.binary}
    return simple[name]()


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string ("a long, b array<double>"); works on executors."""
    return pa.schema([pa.field(n, _arrow_type(t)) for n, t in (x.strip().split(" ", 1) for x in ddl.split(","))])


def _chunked(keys: Sequence[str], func: Callable, schema: pa.Schema, rows: int) -> Callable:
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, limit = 0, rows
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= limit:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                done = int(starts(whole, keys)[-1])
                if done:
                    yield from _out(func(pa.Table.from_batches([whole.slice(0, done)])), schema)
                held, n = [whole.slice(done)], n - done
                limit = max(rows, 2 * n)
        if held:
            yield from _out(func(pa.Table.from_batches(held).combine_chunks()), schema)

    return run


def chunked_map(df: DataFrame, keys: Sequence[str], func: Callable, ddl: str, order: Sequence[str] = (), rows: int = 100_000) -> DataFrame:
    """Call func(table) with many whole groups of keys at once, sorted by (keys, order).

    For groups of bounded size, so that array operations span groups.
    """
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(_chunked(keys, func, arrow_schema(ddl), rows), ddl)


def sorted_chunks(df: DataFrame, keys: Sequence[str], func: Callable, ddl: str, order: Sequence[str] = (), rows: int = 100_000) -> DataFrame:
    """The same where the rows of a group lie in one partition already."""
    return df.sortWithinPartitions(*keys, *order).mapInArrow(_chunked(keys, func, arrow_schema(ddl), rows), ddl)


def grouped_map(df: DataFrame, keys: Sequence[str], func: Callable, ddl: str, order: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """Call func(key, table) for each group of keys; func yields Arrow tables.

    The partition is sorted by (keys, order) and streamed, so only one group is
    in memory at a time and a group's result may be yielded in pieces. Callers
    bound the size of a group.
    """
    spread = df.repartition(n, *keys) if n else df.repartition(*keys)
    return spread.sortWithinPartitions(*keys, *order).mapInArrow(_streamed(keys, func, arrow_schema(ddl)), ddl)
