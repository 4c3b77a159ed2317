"""The folder that driver and executors share, and tables in it that end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of ``path``: any store that Spark itself reads."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def replace_file(spark: SparkSession, source, target) -> None:
    """Rename one Hadoop path to another, in one step even where a file is there already."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    kind = getattr(hadoop, "Options$Rename")
    options = context._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri(), context._jsc.hadoopConfiguration()).rename(source, target, options)


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where that is unset, a local session gets a folder of its own, as in tests; on a cluster a local folder would be
    another one on each executor, so it raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is at it yet. All such paths of a run are deleted when it ends."""
    own = f"{shared_root(spark)}/strandlake/{spark.sparkContext.applicationId}"
    store, at = file_system(spark, own)
    if not store.exists(at):
        store.mkdirs(at)
        store.deleteOnExit(at)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage ends at files that outlive any executor."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *names: str) -> tuple[str, ...]:
    """``names``, with underscores before those that ``columns`` has too (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)
