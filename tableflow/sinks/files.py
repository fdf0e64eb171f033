"""File operations on any store that Spark writes to, through Hadoop's
file-system classes.  Only names and small texts pass through the driver."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return _path(spark, path).getFileSystem(conf)


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    if not exists(spark, folder):
        return []
    return sorted(s.getPath().getName() for s in _system(spark, folder).listStatus(_path(spark, folder)))


def delete(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename unless ``target`` is there; whether it was renamed."""
    jvm = spark.sparkContext._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_system(spark, source).makeQualified(_path(spark, source)).toUri(), conf)
    flags = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(_path(spark, source), _path(spark, target), flags)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str:
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text_new(spark: SparkSession, path: str, text: str) -> bool:
    """Publish a small text under a name that nobody has taken; whether it was
    published.  Readers see the whole text or no file."""
    draft = f"{path.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}"
    stream = _system(spark, draft).create(_path(spark, draft), False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if rename_new(spark, draft, path):
        return True
    delete(spark, draft)
    return False


def swap_in(spark: SparkSession, staged: str, path: str) -> None:
    """Put the staged folder in the place of ``path``.  The old output is moved
    aside first and deleted last."""
    old = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    had = exists(spark, path) and rename_new(spark, path.rstrip("/"), old)
    try:
        if not rename_new(spark, staged, path.rstrip("/")):
            raise FileExistsError(path)
    except Exception:
        if had:
            rename_new(spark, old, path.rstrip("/"))
        raise
    if had:
        delete(spark, old)
