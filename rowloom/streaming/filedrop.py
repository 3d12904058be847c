"""Files as they are dropped in a folder: the same scan, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from rowloom.operators.groups import sentence_groups
from rowloom.operators.rows import kinds
from rowloom.plans.apply import flattened, plan_groups
from rowloom.plans.planner import Options
from rowloom.sources import docx

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def dropped(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return (
        spark.readStream.format("binaryFile")
        .schema(SCHEMA)
        .option("pathGlobFilter", "*.[dD][oO][cC][xX]")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(folder)
    )


def planned_rows(files: DataFrame, options: Options) -> DataFrame:
    """(path, row_number, new_text) of a batch of files: windows run within a file, so each batch is whole by itself."""
    from pyspark.sql import functions as F

    rows = docx.scan(files).where("error is null").withColumn("doc_id", F.xxhash64("path"))
    grouped = sentence_groups(kinds(rows.select("doc_id", "path", "idx", "row_number", "source_text", "target_text")))
    return flattened(grouped, plan_groups(grouped, options)).select("path", "row_number", "new_text")


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Plan dropped files batch by batch and append their rows to ``out``; a batch that runs again writes its own folder
    anew, so nothing is doubled."""

    def write(batch: DataFrame, n: int) -> None:
        planned_rows(batch, options or Options()).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return dropped(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
