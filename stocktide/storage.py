"""Tables that a job keeps between its steps, in the folder that driver and executors share, and files beside them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is put there goes with the application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = spark.sparkContext.master.startswith("local")
        folder = f"{tempfile.gettempdir()}/checkpoints" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    folder = f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"
    files, where = _files(spark, folder)
    files.deleteOnExit(where)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back: the step runs once, and lost executors don't run it again. The tables go with the application."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or any that a pattern stands for, is there."""
    files, where = _files(spark, path)
    found = files.globStatus(where)
    return found is not None and len(found) > 0


def names(spark: SparkSession, pattern: str) -> list[str]:
    """Names of what a pattern stands for, sorted."""
    files, where = _files(spark, pattern)
    return sorted(x.getPath().getName() for x in files.globStatus(where) or [])


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or None if it isn't there."""
    if not exists(spark, path):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that takes the place of the one before at once: readers see the old or the new one, never a part."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files, target = _files(spark, path)
    files.mkdirs(target.getParent())
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = files.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf) if target.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, target, kinds)
