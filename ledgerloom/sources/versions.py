"""Two small tables of files on storage without row-level MERGE.

A write is a folder that Spark's commit protocol finishes with ``_SUCCESS``; unfinished ones are never read, and writing
a version or batch again replaces it, so a micro-batch that runs twice leaves the same table.  Reads and writes name
the parts they touch, so their cost follows the batch and not the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class _Folder:
    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._join = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._join(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, below: str = "") -> list[str]:
        root = self._join(self.path + below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def _finished(self) -> list[str]:
        return [n for n in self._names() if self._fs.exists(self._join(f"{self.path}/{n}/_SUCCESS"))]

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._join(path))

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)


class BucketTable(_Folder):
    """Rows dealt over ``buckets`` by the hash of a key.  A version replaces the buckets that its rows fall in, or all of
    them; the current rows of a bucket are those of the highest version that has it.  The last two versions of each
    bucket stay, so readers of the one before are not cut off."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 32) -> None:
        super().__init__(spark, path, schema)
        self.key, self.buckets = key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self, before: int | None = None) -> dict[int, list[str]]:
        """The folders that hold each bucket, oldest first; a whole version starts all of them anew."""
        held: dict[int, list[str]] = {}
        for name in sorted(self._finished(), key=lambda n: n[2:]):
            if before is not None and int(name[2:]) >= before:
                continue
            if name.startswith("a-"):
                held = {b: [] for b in held}
            for part in self._names(f"/{name}"):
                if part.startswith("bucket="):
                    held.setdefault(int(part[7:]), []).append(f"{self.path}/{name}/{part}")
        return held

    def rows(self, only: set[int] | None = None, before: int | None = None) -> DataFrame:
        """The current rows, or those current before a version number, of all or only some buckets."""
        paths = [p[-1] for b, p in self.versions(before).items() if p and (only is None or b in only)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self._empty()

    def write(self, rows: DataFrame, version: int, whole: bool = False) -> None:
        out = rows.withColumn("bucket", self.bucket()).repartition("bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{'a' if whole else 'w'}-{version:012d}")
        for paths in self.versions().values():
            for old in paths[:-2]:
                self._fs.delete(self._join(old), True)


class BatchedTable(_Folder):
    """Append-only rows by batch: a batch that runs again replaces its own folder and sees all others."""

    def read(self, without: int | None = None) -> DataFrame:
        paths = [f"{self.path}/{n}" for n in self._finished() if n.startswith("batch=") and n != f"batch={without}"]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self._empty()

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/batch={batch}")  # most of a row are digests in hex
