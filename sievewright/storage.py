"""Folders that driver and executors share, and tables in them that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, one of our own on a single machine, as in tests; on a cluster each executor would write to its
    own disk, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sievewright.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="sievewright-")
        spark.conf.set("spark.sievewright.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/sievewright/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def _at(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def put(spark: SparkSession, path: str, body: str) -> None:
    """A small file of this name."""
    at, fs = _at(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(body.encode()))
    out.close()


def get(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    at, fs = _at(spark, path)
    source = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(source)).decode()
    finally:
        source.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if it isn't there."""
    at, fs = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def publish(spark: SparkSession, path: str, body: str) -> bool:
    """Write a small file of this name unless there is one; False if there is.

    The body is written under another name, which readers pass over, and then takes the name in one step that fails
    where the name is taken: of several writers exactly one succeeds, and no reader sees a part of it.
    """
    at, fs = _at(spark, path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    put(spark, draft.toString(), body)
    try:
        if fs.getUri().getScheme() == "file":
            # A rename replaces what is there; a link doesn't.
            os.link(draft.toUri().getPath(), at.toUri().getPath())
            return True
        jvm = spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(draft), fs.makeQualified(at), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.toString():
            return False
        raise
    finally:
        fs.delete(draft, False)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of df has, whatever its case: the name itself, or with underscores before it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
