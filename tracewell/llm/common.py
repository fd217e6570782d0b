"""What the operators of this package share: written intermediate tables, and texts in bounded slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextvars import ContextVar
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A word is a maximal run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that map_texts() works on at once.
PART_BYTES = 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Folders that are cleared when their application ends.
_to_clear: set[str] = set()
#: The tables written so far in the innermost saved_only() at work.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tracewell-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again: lineage ends here, and a lost executor costs nothing.

    The tables of an application lie in a folder of its own, which goes when the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if folder not in _to_clear:
        _to_clear.add(folder)
        there = spark._jvm.org.apache.hadoop.fs.Path(folder)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    if (written := _written.get()) is not None:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_only(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make(), written as saved() does; the tables that make() wrote on the way are removed then, so nothing else may read them.

    Spark removes the shuffle files and broadcasts of earlier plans when the driver's JVM collects them, which a large heap puts off for long; so it is asked to.
    """
    outer, written = _written.get(), []
    token = _written.set(written)
    try:
        result = saved(make(), name)
    finally:
        _written.reset(token)
    spark = result.sparkSession
    for path in written[:-1]:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    if outer is not None:
        outer.append(written[-1])
    spark._jvm.System.gc()
    return result


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_same(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined to right where the named columns are the same, nulls included; the columns of left, then the others of right."""
    there = right.withColumnsRenamed({n: f"_right_{n}" for n in names})
    on = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"_right_{n}")) for n in names))
    return left.join(there, on, how).drop(*(f"_right_{n}" for n in names))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def map_texts(docs: DataFrame, keep: Sequence[str] | None, fields: str, maker: Callable[[], Callable[[list[str]], dict[str, Sequence]]], text: str = "text") -> DataFrame:
    """The columns `keep` of docs (all by default) and new ones, `fields` (DDL), made from whole texts batch by batch.

    maker is called once in each task; what it returns turns texts (null: empty) into the new columns. Kept
    columns pass through as Arrow arrays, so nulls and large whole numbers stay as they are. A kept column
    with the name of a new one is dropped.
    """
    new = T.StructType.fromDDL(fields)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    docs = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([*(docs.schema[c] for c in keep), *new.fields])
    types = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = maker()
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(text)), 0).to_pylist()
            for part in slices(sizes, PART_BYTES):
                batch = whole.slice(part.start, part.stop - part.start)
                made = work([t if t is not None else "" for t in batch.column(text).to_pylist()])
                arrays = [*(batch.column(c) for c in keep), *(made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], t) for n, t in zip(new.names, types, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *new.names])

    return docs.mapInArrow(run, schema)


def slices(sizes: Sequence[int], most: int) -> Iterator[slice]:
    """Consecutive slices of the rows, each of at most `most` bytes in all, or of one row."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))
