"""Folders that the driver and all executors see, and files that appear there whole or not at all."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a local master without one gets a temporary folder, a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quartzframe-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = file_system(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, fs = file_system(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    where, fs = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def publish(spark: SparkSession, made: str, path: str) -> bool:
    """Moves ``made`` to ``path`` in one step; false, and ``made`` stays, if something is there already."""
    jvm, (source, fs), (target, _) = spark._jvm, file_system(spark, made), file_system(spark, path)
    fs.mkdirs(target.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        return False
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    plain[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(source, target, plain)  # refuses a path that is there, where a file system's rename may overwrite it
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small document so that readers see all of it or nothing; false if the path is taken."""
    made = f"{path}.{uuid.uuid4().hex}"
    where, fs = file_system(spark, made)
    out = fs.create(where, False)
    out.write(bytearray(text.encode()))
    out.close()
    if publish(spark, made, path):
        return True
    fs.delete(where, False)
    return False


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = file_system(spark, path)
    return bytes(fs.openFile(where).build().get().readAllBytes()).decode()
