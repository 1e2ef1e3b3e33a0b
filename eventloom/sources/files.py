"""Files and folders of tables, through the file system that Spark itself uses for their paths."""

from __future__ import annotations

from pyspark.sql import SparkSession


def system(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = system(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or a whole folder; a path that is not there is left so."""
    fs, where = system(spark, path)
    fs.delete(where, True)


def make(spark: SparkSession, path: str) -> None:
    fs, where = system(spark, path)
    fs.mkdirs(where)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, where = system(spark, source)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot move {source} to {target}")


def sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    """Paths right below a folder with their bytes; hidden files are left out."""
    fs, where = system(spark, folder)
    if not fs.exists(where):
        return {}
    return {str(s.getPath()): s.getLen() for s in fs.listStatus(where) if str(s.getPath().getName())[0] not in "._"}


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Paths right below a folder, in order."""
    return sorted(sizes(spark, folder))
