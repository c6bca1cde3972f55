"""Chunks kept as Parquet, parted by knowledge base and source, so that a source is replaced or deleted by its folder alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ["kb_id", "source_id"]


class ChunkStore:
    """path: any store that Spark writes to; schema: the chunks' columns, kb_id and source_id among them."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, kb_id: str | None = None, source_id: str | None = None) -> DataFrame:
        """The chunks, of one knowledge base or source if named; other folders aren't read. An empty store has no rows."""
        path, fs = self._folder()
        df = self.spark.read.schema(self.schema).parquet(self.path) if fs.exists(path) else self.spark.createDataFrame([], self.schema)
        for name, value in zip(PARTS, (kb_id, source_id), strict=True):
            df = df.where(F.col(name) == value) if value is not None else df
        return df

    def store(self, chunks: DataFrame) -> int:
        """Adds chunks and returns how many they are; hot sources are spread over several files by AQE."""
        before = self.count()
        chunks.hint("rebalance", *PARTS).write.mode("append").partitionBy(*PARTS).parquet(self.path)
        return self.count() - before

    def delete(self, source_id: str) -> int:
        """Deletes a source's chunks in every knowledge base and returns how many they were."""
        rows = self.read(source_id=source_id)
        n = rows.count()
        if n:
            _, fs = self._folder()
            jvm = self.spark._jvm
            # one folder for each knowledge base that has the source
            folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")
            for row in rows.select(folder).distinct().collect():
                fs.delete(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["folder"])), True)
        return n

    def count(self, kb_id: str | None = None, source_id: str | None = None) -> int:
        return self.read(kb_id, source_id).count()
