"""Statements that arrive over time: N-Triples files, read as they come, each statement kept once and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.triples import COLUMNS, parse_ntriples


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    return parse_ntriples(spark.readStream.text(folder))


def append(t: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the statements of t to Parquet files; ones that are there already are left out.

    A batch is compared with what is stored, so the query holds no state that grows. It is written to a folder of its own
    number, over what an earlier attempt of the same batch may have left, so a batch that runs again adds nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        new = batch.select(COLUMNS).distinct()
        if fs.exists(root):
            stored = spark.read.option("basePath", path).schema(", ".join(f"{c} string" for c in COLUMNS) + ", batch long").parquet(path)
            new = new.join(stored.where(f"batch < {number}").select(COLUMNS), COLUMNS, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = t.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
