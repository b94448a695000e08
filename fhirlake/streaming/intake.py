"""New bundle files appended to bronze as they arrive.

The incremental form of the append load: each micro-batch of files is staged, flattened
and loaded as one load batch. A micro-batch that is repeated after a failure has the same
batch id and replaces its own rows, so no file is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fhirlake.operators.flatten import SOURCE_TYPES, flatten_all
from fhirlake.sources import bronze, bundles


def start_intake(
    spark: SparkSession,
    folder: str,
    checkpoint: str,
    staging: str,
    run: str,
    database: str = bronze.BRONZE,
    max_files: int | None = None,
    strict: bool = True,
    tz: str | None = None,
) -> StreamingQuery:
    """Load all files not loaded yet, then stop.

    ``run`` prefixes the batch ids and belongs to ``checkpoint``: a new checkpoint needs a
    new name, since micro-batch numbers start again. ``max_files`` bounds one micro-batch.
    """
    bronze.create_bronze(spark, database)
    contents = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(contents).option("pathGlobFilter", bundles.FILE_PATTERN)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    docs = reader.load(folder).filter(bundles.is_patient_file(F.col("_metadata.file_name")))
    docs = docs.select(F.col("_metadata.file_path").alias("bundle_id"), F.col("content").alias("value"))

    def load(batch: DataFrame, number: int) -> None:
        label = f"{run}-{number:09d}"
        staged = bundles.stage_bundles(batch, f"{staging.rstrip('/')}/{label}", SOURCE_TYPES)
        for record, rows in flatten_all(staged.resources).items():
            bronze.load_bronze(
                rows, record, "rerun", batch_id=label, strict=strict, tz=tz, database=database
            )

    return (
        docs.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
