"""Running a stream to the end of what is available, with results in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder where the cluster keeps checkpoints; a temporary one where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="millrace-stream-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def newest(updates: DataFrame, *keys: str) -> DataFrame:
    """The last row that an update-mode stream put out for each key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    last = updates.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("last"))
    return last.select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream with trigger availableNow. complete: the last result; append and update: all that was put out,
    with the number of its batch in `batch`."""
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def put(rows: DataFrame, batch: int) -> None:
        at = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={batch}"
        rows.write.mode("overwrite").parquet(at)  # a batch that runs again replaces itself

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
