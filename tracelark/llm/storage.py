"""Tables that cut lineage: written once to the shared folder, read back by whoever needs them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one where that is unset and Spark is this one process."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _put(df: DataFrame, path: str, most_rows: int | None = None) -> DataFrame:
    large = {"parquet.block.row.count.limit": str(most_rows), "parquet.column.statistics.enabled": "false", "parquet.size.statistics.enabled": "false"}
    df.write.options(**(large if most_rows else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _counted(df: DataFrame, where: str) -> tuple[DataFrame, Observation]:
    """``df`` with an observation of how many of its rows meet ``where``, made as they are written: no job of its own."""
    seen = Observation()
    return df.observe(seen, F.count_if(F.expr(where)).alias("n")), seen


def written(df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a lost executor costs a reread, not a recomputation.

    Results may read it until the application ends; then it is deleted. A task holds a row group whole when it writes it and
    again, with its columns laid out, when it reads it, and Parquet doesn't look at its size before the 100th row; tables of
    large rows give ``most_rows`` of one. These are written without statistics, whose least and greatest values stay whole in
    the heap until the file is closed.
    """
    path = f"{shared_dir(df.sparkSession)}/tracelark/{name}-{uuid.uuid4().hex}"
    out = _put(df, path, most_rows)
    files, folder = _file_system(df.sparkSession, path)
    files.deleteOnExit(folder)
    return out


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``written``, and the number of rows."""
    df, seen = _counted(df, "true")
    return written(df, name), seen.get["n"]


class Scratch:
    """Written tables of one computation, dropped together once its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count = spark, f"{shared_dir(spark)}/tracelark/scratch-{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        return _put(df, f"{self.path}/{name}-{self.count}")

    def counted(self, df: DataFrame, name: str, where: str = "true") -> tuple[DataFrame, int]:
        """``written``, and how many of its rows meet ``where``."""
        df, seen = _counted(df, where)
        return self.written(df, name), seen.get["n"]

    def drop(self) -> None:
        """Deletes the tables, through Spark's own file system layer."""
        files, folder = _file_system(self.spark, self.path)
        files.delete(folder, True)
