"""Path questions answered by the file system Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _hadoop_path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    system, hadoop = _hadoop_path(spark, path)
    return system.exists(hadoop)


def is_folder(spark: SparkSession, path: str) -> bool:
    system, hadoop = _hadoop_path(spark, path)
    return system.exists(hadoop) and system.getFileStatus(hadoop).isDirectory()


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder; empty when the folder is absent."""
    system, hadoop = _hadoop_path(spark, path)
    if not system.exists(hadoop):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(hadoop))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files below a folder."""
    system, hadoop = _hadoop_path(spark, path)
    return system.getContentSummary(hadoop).getLength()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; false if it exists, whoever made it."""
    system, hadoop = _hadoop_path(spark, path)
    if system.exists(hadoop):
        return False
    try:
        stream = system.create(hadoop, False)
    except Exception:
        if system.exists(hadoop):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    system, hadoop = _hadoop_path(spark, path)
    stream = system.open(hadoop)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote; nothing happens if it is gone."""
    system, hadoop = _hadoop_path(spark, path)
    system.delete(hadoop, True)
