"""What the operators share: reading tables, cutting lineage, and running a function over whole texts in Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts go through numpy in runs of about this many bytes, so that memory does not follow the Arrow batch.
SLICE_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_ready(spark: SparkSession) -> None:
    """The shared folder is the cluster's own setting; only a session in one process may do without, and gets a local one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="spanline-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept as a table in the shared checkpoint folder: a lost executor costs no recomputation, and later joins may split its large keys."""
    spark = df.sparkSession
    checkpoint_ready(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*kept: DataFrame) -> None:
    """Deletes tables made by cut() that nothing reads any more."""
    for df in kept:
        context = df.sparkSession.sparkContext
        for file in {path.rpartition("/")[0] for path in df.inputFiles()}:
            where = context._jvm.org.apache.hadoop.fs.Path(file)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def free_name(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of docs has it, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small(df: DataFrame, rows: int) -> bool:
    """Whether df, a kept table, has at most `rows` rows; only then may it be broadcast."""
    return df.count() <= rows


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """texts in runs of at most `limit` bytes, but one text at least."""
    ends = texts.offsets.to_numpy() if hasattr(texts, "offsets") else None
    if ends is None:
        import numpy as np

        ends = np.frombuffer(texts.buffers()[1], dtype="i4" if pa.types.is_string(texts.type) else "i8")[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(ends.searchsorted(ends[start] + limit, "right")) - 1)
        yield texts.slice(start, stop - start)
        start = stop


def small_batches(spark: SparkSession) -> None:
    """Texts go to tasks in Arrow batches of bounded rows and bytes: both the JVM and Python hold a batch as a whole. A lower setting of the session stays."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    if not spark.conf.get(size).removesuffix("b").isdigit() or not 0 < int(spark.conf.get(size).removesuffix("b")) <= BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


def arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64(), T.FloatType: pa.float32()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind])
    return simple[type(kind)]


def over_texts(docs: DataFrame, work: Callable[[], Callable[[list], dict]], fields: str, out: str = "__found", text: str = "text") -> DataFrame:
    """docs with a struct column `out` of `fields` (DDL), made from the column `text` alone.

    `work` runs once in each task and gives a function from a list of texts (None stays None) to a dict of columns.
    All columns of docs are kept as they are, whatever their names; texts are given whole, in runs of bounded size.
    """
    kind = T.StructType.fromDDL(fields) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(fields)
    small_batches(docs.sparkSession)
    names = docs.columns
    at, plain = names.index(text), docs.toDF(*[f"c{k}" for k in range(len(names))])  # a name with a dot can't be passed to a task
    schema = T.StructType([*plain.schema.fields, T.StructField("found", kind)])
    as_arrow = arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = work()
        for batch in batches:
            start = 0
            for part in slices(batch.column(at)):
                got = do(part.to_pylist())
                found = pa.StructArray.from_arrays([pa.array(got[f.name], f.type) for f in as_arrow], fields=list(as_arrow))
                own = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays([*own.columns, found], names=[*batch.schema.names, "found"])
                start += len(part)

    return plain.mapInArrow(run, schema).toDF(*names, out)


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text only, so that other columns, whatever their names, never reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ascii_words(lower: bool = True) -> bytes:
    """A table for bytes.translate: letters, digits and bytes beyond ASCII stay (A-Z lower-cased), all else turns into a space."""
    keep = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in range(128):
        if chr(c).isalnum():
            keep[c] = ord(chr(c).lower() if lower else chr(c))
    return bytes(keep)


