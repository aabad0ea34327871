"""Arrow IPC files as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..errors import SpecError
from .catalog import ROW

#: A file's rows come in order of its batches, this many at most to each.
_STRIDE = 2**40


def _open(data: bytes) -> Iterator[pa.RecordBatch]:
    """Batches of an IPC file, or of an IPC stream."""
    if data[:6] == b"ARROW1":
        reader = pa.ipc.open_file(pa.BufferReader(data))
        yield from (reader.get_batch(i) for i in range(reader.num_record_batches))
    else:
        yield from pa.ipc.open_stream(pa.BufferReader(data))


def read_ipc(spark: SparkSession, paths: Sequence[str], storage_options: Mapping[str, str] | None = None) -> DataFrame:
    """All files of equal schema, each read by one task through Spark's binary source (so any store that Spark reads will do,
    with its options), with a hidden row order. A file must fit in a task; only its schema comes to the driver."""
    files = spark.read.format("binaryFile").options(**(storage_options or {})).load(list(paths))
    named = files.select("path").orderBy("path").collect()
    if not named:
        raise SpecError(f"{', '.join(paths)}: no files", "file_not_found")

    def header(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for content in batch.column(0):
                schema = next((b.schema for b in _open(content.as_py())), pa.schema([]))
                yield pa.RecordBatch.from_arrays([pa.array([schema.serialize().to_pybytes()])], names=["schema"])

    found = files.filter(F.col("path") == named[0].path).select("content").mapInArrow(header, "schema binary").first()
    schema = from_arrow_schema(pa.ipc.read_schema(pa.BufferReader(bytes(found.schema))))
    names = [f.name for f in schema.fields]
    numbers = spark.createDataFrame([(r.path, i) for i, r in enumerate(named)], "path string, number long")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for number, content in zip(batch.column("number").to_pylist(), batch.column("content"), strict=True):
                at = number * _STRIDE
                for part in _open(content.as_py()):
                    yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(range(at, at + len(part)), pa.int64())], names=[*names, ROW])
                    at += len(part)

    return files.select("path", "content").join(F.broadcast(numbers), "path").select("number", "content").mapInArrow(run, StructType([*schema.fields, StructField(ROW, LongType())]))
