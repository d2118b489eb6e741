"""What the operators of this subpackage share: table reads, scratch space, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as bytes: \x20 and \x09-\x0D.
SPACE = b" \t\n\x0b\x0c\r"
SPACE_STR = SPACE.decode()

#: Rows and bytes that Spark hands to Python at once; texts can be long, so both are bounded.
ARROW_ROWS, ARROW_BYTES = 500, 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, which plans read when they run; a session's own lower bounds stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = int(spark.conf.get(name).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(name, most)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local master may do without that setting (one beside its tables then)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return root.rstrip("/")


#: Scratch paths written and not released yet, in order.
_made: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows go to a table in the shared folder, which outlives any executor; readers take the columns they need."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """Where scratch stands now, for release()."""
    return len(_made)


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the scratch tables made since a mark. Frames that operators returned before read them: write those first."""
    while len(_made) > since:
        remove_path(spark, _made.pop())


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(conf).exists(where)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's values, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def table_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def with_columns(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """The batch with columns set; one of the same name is replaced in its place."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, values in columns.items():
        if name in names:
            arrays[names.index(name)] = values
        else:
            names.append(name)
            arrays.append(values)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def map_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow for a function from one record batch to one or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def hash_share(column: str, share: float):
    """A filter that keeps about that share of the distinct values of a column, the same ones each time."""
    return F.pmod(F.xxhash64(F.lit("share"), F.col(column)), F.lit(1 << 20)) < int(share * (1 << 20))


def schema_with(df: DataFrame, **types: str) -> str:
    """The DDL of df's columns and these; those that df has already are retyped in place."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields} | types
    return ", ".join(f"`{k.replace('`', '``')}` {v}" for k, v in fields.items())
