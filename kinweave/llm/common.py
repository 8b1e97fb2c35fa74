"""Session helpers shared by the training-data operators."""
from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows in an Arrow batch; kernels split batches by bytes themselves, this bounds what one transfer holds.
BATCH_ROWS = 1000
NARROW_ROWS = 20_000
BATCH_BYTES = 16 << 20


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own on a single machine, and none on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="kinweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def tune(spark: SparkSession, narrow: bool = False) -> None:
    """Arrow batches of bounded bytes, as one row may hold a very long text; more rows where they are narrow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(NARROW_ROWS if narrow else BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Paths that materialize has written, by what it returned.
_written: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: Shuffle files go at the end of the query that wrote them, not when the driver next collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: So many files a task writes side by side; with fewer than there are folders, rows would be sorted first.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def _write(df: DataFrame, name: str, **conf: str) -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinweave/{name}-{uuid.uuid4().hex}"
    conf = {_CLEAN: "true"} | conf
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        to = df.write.option("compression", "zstd")
        (to.partitionBy("apart") if "apart" in df.columns else to).parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: its lineage ends there, with its shuffle files, and a lost executor costs no recomputation."""
    path = _write(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def materialize_apart(df: DataFrame, apart: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of df (no column of which is named apart) for which the condition doesn't hold, and those for which it does, each to be discarded by itself; written in one run."""
    path = _write(df.withColumn("apart", apart.cast("int")), name, **{_WRITERS: "2"})
    out = []
    for i in (0, 1):
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/apart={i}")
        # none of this kind: no folder
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).mkdirs(at)
        out.append(df.sparkSession.read.schema(df.schema).parquet(f"{path}/apart={i}"))
        _written[out[-1]] = f"{path}/apart={i}"
    return out[0], out[1]


def discard(*made: DataFrame | None) -> None:
    """Deletes what materialize returned; nothing that is still to run may read it. Other DataFrames stay."""
    for df in made:
        path = _written.pop(df, None) if df is not None else None
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def unused(name: str, columns: list[str]) -> str:
    """name, with as many _ before it as it takes to clash with none of the columns (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, name: str, rid: str = "rid") -> DataFrame:
    """docs with a row number, written once: every later job reads the same numbers, however the input is split when it runs."""
    return materialize(docs.withColumn(rid, F.monotonically_increasing_id()), name)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_batch(make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]):
    """A mapInArrow function; make() runs once in each task and returns what is called on each batch."""

    def run(batches):
        f = make()
        for b in batches:
            if b.num_rows:
                yield from f(b)

    return run


def arrow_schema(fields: str) -> pa.Schema:
    """From 'name type' pairs: the Arrow counterpart of a Spark DDL string of simple types."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ", 1) for x in fields.split(","))])


def bounded_sample(rows: DataFrame, target: int) -> DataFrame:
    """About target rows, each chosen by a hash of its place in the scan, and never more than twice as many."""
    share = min(1.0, target / max(rows.count(), 1))
    return rows.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(2 * target)
