"""Path checks through the Hadoop FileSystem of the session (local disks, HDFS and object stores alike)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def hadoop_fs(spark: SparkSession, path: str):
    """(FileSystem, Path) for ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_fs(spark, path)
    return bool(fs.exists(p))


def subdirs(spark: SparkSession, path: str) -> list[str]:
    fs, p = hadoop_fs(spark, path)
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]


def files(spark: SparkSession, path: str) -> list[str]:
    fs, p = hadoop_fs(spark, path)
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p) if st.isFile()]


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text (a manifest, a log entry)."""
    fs, p = hadoop_fs(spark, path)
    stream = fs.open(p)
    try:
        return str(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it is there whole or not at all: another name first, then a rename."""
    fs, p = hadoop_fs(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"could not move {path}.part to {path}")
