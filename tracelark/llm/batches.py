"""How many bytes of whole texts a task hands to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def whole_text_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lowers the session's Arrow batches to ``most`` bytes, or one row: a batch stands in the executor and again in its
    Python worker, and Spark's own bound is 64 MB. Every operator that hands whole texts to Python calls this, so none
    depends on what ran before; no result depends on it. It is read when a result is computed, so it stays set."""
    now = int(spark.conf.get(SETTING).lower().rstrip("b"))
    if not 0 < now <= most:
        spark.conf.set(SETTING, f"{most}b")
