"""A keyed table that takes batches: rows are hashed into buckets and a batch rewrites only the buckets it touches.

A manifest names the folder of each bucket's rows and the last batch taken. A batch's buckets are written under its own
number, and the next manifest is made at the end, under a name that only one writer can make: readers see the table
before the batch or after it. A batch that died on the way is written again over what it left; one that was taken
already changes nothing.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketTable:
    """rows of schema, one for each key. order: names of columns; of several rows of a key the one with the greatest values stays.

    Without an order the row of the later batch stays; within a batch any. Of the columns in most the greatest value stays,
    whatever row it is from. Null keys are a key like others.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, order: list[str] | None = None, buckets: int = 64, most: list[str] | None = None):
        self.spark, self.root, self.schema, self.key, self.order, self.buckets = spark, root.rstrip("/"), schema, key, order, buckets
        self.most = most or []
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path("manifests"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def manifest(self) -> dict:
        """{"number", "batch", "at": {bucket: folder}} of the newest manifest."""
        numbers = [int(f.getPath().getName()) for f in self.fs.listStatus(self._path("manifests")) if f.getPath().getName().isdigit()]
        if not numbers:
            return {"number": 0, "batch": -1, "at": {}}
        stream = self.fs.open(self._path(f"manifests/{max(numbers)}"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _switch(self, manifest: dict) -> None:
        """The manifest is written aside and renamed; where its number is taken, another writer was faster."""
        number = manifest["number"]
        aside = self._path(f"manifests/_aside-{number}-{manifest['batch']}")
        stream = self.fs.create(aside, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self.fs.exists(self._path(f"manifests/{number}")) or not self.fs.rename(aside, self._path(f"manifests/{number}")):
            raise RuntimeError(f"manifest {number} was made by another writer")

    def _rows(self, at: dict) -> DataFrame:
        folders = sorted(set(at.values()))
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        """The table as of the newest manifest."""
        return self._rows(self.manifest()["at"])

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, number: int) -> bool:
        """Take a batch, numbers rising; False if it was taken before. The driver gets the numbers of the touched buckets."""
        before = self.manifest()
        if number <= before["batch"]:
            return False
        names = self.spark.createDataFrame([], self.schema).columns
        new = batch.select(*names)
        touched = sorted(r[0] for r in new.select(self.bucket().alias("b")).distinct().collect())
        stored = self._rows({b: f for b, f in before["at"].items() if int(b) in touched})
        x = stored.withColumn("_late", F.lit(0)).unionByName(new.withColumn("_late", F.lit(1)))
        rank = F.struct(*[F.col(c) for c in self.order or []], "_late")
        kept = x.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*names), rank).alias("r"), *[F.max(c).alias(f"_most_{c}") for c in self.most])
        kept = kept.select(*[F.col(f"_most_{c}" if c in self.most else f"r.{c}").alias(c) for c in names])
        folder = f"{self.root}/rows/{number}"
        kept.withColumn("_b", self.bucket()).repartition(max(1, min(len(touched), self.buckets)), "_b").write.mode("overwrite").partitionBy("_b").parquet(folder)
        at = before["at"] | {str(b): f"{folder}/_b={b}" for b in touched}
        try:
            self._switch({"number": before["number"] + 1, "batch": number, "at": at})
        except Py4JJavaError as e:
            raise RuntimeError(f"manifest {before['number'] + 1} could not be made") from e
        return True
