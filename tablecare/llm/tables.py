"""Tables of a running job in the folder the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tablecare.session import scratch_path


class Scratch:
    """Tables written below ``spark.checkpoint.dir`` and read again.

    They cut the lineage: a lost executor costs the running tasks only.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)
        self._tables = 0

    def keep(self, df: DataFrame, *partition_by: str) -> DataFrame:
        self._tables += 1
        path = f"{self.root}/{self._tables}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def dealt(self, df: DataFrame, column: str) -> DataFrame:
        """The table, dealt by a column into one file per shuffle partition. Joins on just
        that column move the other side only. The catalog keeps no entry of it."""
        self._tables += 1
        name = f"scratch_{uuid.uuid4().hex}"
        count = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = df.repartition(count, column).write.bucketBy(count, column).format("parquet")
        writer.option("compression", "zstd").option("path", f"{self.root}/{self._tables}").saveAsTable(name)
        table = self.spark.table(name)
        self.spark.sql(f"drop table {name}")  # its files stay, as their place was given
        return table

    def drop(self) -> None:
        """Delete all tables; nothing may read them any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
