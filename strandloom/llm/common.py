"""Helpers shared by the training-data operators: shared storage, staged tables, file access from workers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a whole URI.

    It is the session's ``spark.checkpoint.dir``; a bare path lies in the session's default file system. Where it is
    unset a fresh local folder is used and set as the checkpoint directory, in local mode only.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        folder = context._jsc.sc().getCheckpointDir()
        if folder.isDefined():
            root = folder.get()
        elif context._jsc.sc().isLocal():
            root = "file://" + tempfile.mkdtemp(prefix="strandloom-")
            context.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _own_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/strandloom-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name of its own below the shared root; nothing is created yet."""
    return f"{_own_root(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Remove what this application has staged. Results that were not written elsewhere are gone then."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_own_root(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_parser(spark: SparkSession) -> None:
    """Empty the automata that the SQL parser has cached on the driver: a very long expression leaves tens of MB there.

    They are shared and filled again as needed; other parsers at work may be slower for a moment, but read the same.
    """
    spark._jvm.org.apache.spark.sql.catalyst.parser.SqlBaseParser(None).getInterpreter().clearDFA()


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(name: str, taken: list[str]) -> str:
    """``name`` with underscores until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` for ``mapInArrow``, giving what it freed back to the system at its end: workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's filesystem and path for a URI (file, hdfs, s3, gs ...), for use inside workers."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def publish(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Give a finished file its name; a reader never sees one that is half written."""
    fs.move(temporary, final)


def ensure_folder(uri: str) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)
