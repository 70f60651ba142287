"""Files from memory, and contents from where they can be found."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import MAX_BYTES, file_name, file_tree, is_ignored, is_skipped, language


class FileSource(Protocol):
    """What gives files: filePath, name, size, language, content."""

    def files(self, spark: SparkSession) -> DataFrame: ...


class FolderSource:
    """Files under a folder that Spark can read."""

    def __init__(self, root: str, ignore: list[str] = (), hidden: bool = False) -> None:
        self.root, self.ignore, self.hidden = root, list(ignore), hidden

    def files(self, spark: SparkSession) -> DataFrame:
        return file_tree(spark, self.root, self.ignore, self.hidden)


class MemorySource:
    """Files given as a mapping of path to text or bytes, by the rules of a folder."""

    def __init__(self, contents: Mapping[str, str | bytes], ignore: list[str] = (), hidden: bool = False, max_bytes: int = MAX_BYTES) -> None:
        self.contents, self.ignore, self.hidden, self.max_bytes = contents, list(ignore), hidden, max_bytes

    def files(self, spark: SparkSession) -> DataFrame:
        data = [(k, bytearray(v.encode() if isinstance(v, str) else v)) for k, v in sorted(self.contents.items())]
        rows = spark.createDataFrame(data, "filePath string, content binary").withColumn("size", F.octet_length("content").cast("long")).filter(F.col("size") <= self.max_bytes)
        path = F.col("filePath")
        rows = rows.filter(~is_skipped(path) & ~is_ignored(path, self.ignore))
        if not self.hidden:
            rows = rows.filter(~path.rlike(r"(^|/)\."))
        return rows.select(path, file_name(path).alias("name"), "size", language(path).alias("language"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def resolve(asked: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Contents of paths (filePath) from the first source (filePath, content), else the second.

    A path in neither has a null content and an error.
    """
    a = first.select("filePath", F.col("content").alias("_a"))
    b = second.select("filePath", F.col("content").alias("_b"))
    found = asked.select("filePath").distinct().join(a, "filePath", "left").join(b, "filePath", "left")
    content = F.coalesce("_a", "_b")
    return found.select("filePath", content.alias("content"), F.when(content.isNull(), F.concat(F.lit("not found: "), "filePath")).alias("error"))
