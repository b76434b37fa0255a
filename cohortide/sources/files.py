"""Small files and folder listings through the file system that Spark itself uses.

Only the driver calls these, for folders whose entries it wrote; rows never pass through here.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """Entries of a folder, sorted; of one that does not exist none."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where))


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Make a new file appear whole, by renaming. False if another writer was first."""
    fs, where = _at(spark, path)
    if fs.exists(where):
        return False
    part = where.suffix(".part-" + spark._jvm.java.util.UUID.randomUUID().toString())
    out = fs.create(part, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    moved = bool(fs.rename(part, where))
    if not moved:
        fs.delete(part, False)
    return moved


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Let a folder take another's place, by renaming."""
    fs, where = _at(spark, target)
    fs.delete(where, True)
    if not fs.rename(_at(spark, source)[1], where):
        raise OSError(f"could not rename {source} to {target}")
