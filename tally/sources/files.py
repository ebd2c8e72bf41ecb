"""Small file operations on any store that Spark reaches (Hadoop file systems)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there completely."""
    return exists(spark, f"{path}/_SUCCESS")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    fs, place = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []


def touch(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.create(place, True).close()


def move(spark: SparkSession, path: str, to: str) -> None:
    fs, place = _at(spark, path)
    if not fs.rename(place, _at(spark, to)[1]):
        raise OSError(f"could not move {path} to {to}")


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, place = _at(spark, path)
    out = fs.create(place, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())
