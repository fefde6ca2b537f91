"""Small text files and listings on whatever file system a path names."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``, sorted."""
    if not exists(spark, path):
        return []
    found = _fs(spark, path).listStatus(_path(spark, path))
    return sorted(s.getPath().getName() for s in found if s.isDirectory())


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing points to any more."""
    _fs(spark, path).delete(_path(spark, path), True)


def has_parquet(spark: SparkSession, path: str) -> bool:
    """Whether some Parquet file lies anywhere below ``path``."""
    if not exists(spark, path):
        return False
    files = _fs(spark, path).listFiles(_path(spark, path), True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def create_new(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if it is there already.  As safe between two writers as the
    file system's create without overwrite (one step on HDFS)."""
    where = _fs(spark, path)
    where.mkdirs(_path(spark, path).getParent())
    try:
        where.create(_path(spark, path), False).close()
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()) or exists(spark, path):
            return False
        raise
    return True


def read_json(spark: SparkSession, path: str, default):
    """A small JSON file; the default where it is missing.  One that is no JSON raises."""
    if not exists(spark, path):
        return default
    source = _fs(spark, path).open(_path(spark, path))
    try:
        text = bytes(source.readAllBytes()).decode("utf-8")
    finally:
        source.close()
    try:
        return json.loads(text)
    except ValueError as error:
        raise ValueError(f"{path} is no JSON") from error


def write_json(spark: SparkSession, path: str, value) -> None:
    """Write beside the target, then rename over it, so readers see old or new."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, fresh = _path(spark, path), _path(spark, path + ".next")
    out = _fs(spark, path).create(fresh, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, sort_keys=True, default=str).encode("utf-8")))
    finally:
        out.close()
    rename = getattr(hadoop, "Options$Rename")
    how = spark._sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fresh, target, how)
