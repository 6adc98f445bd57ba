"""The batch annotation of `plans.annotate` over a growing folder of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanwright.plans.annotate import annotate
from spanwright.sources.documents import to_json_documents

DOCUMENT = "doc_id string, text string"


def watch_json(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Stream of (doc_id, text) JSON lines files."""
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", max_files).json(folder)


def annotate_stream(docs: DataFrame, output: str, checkpoint: str, **stages):
    """Annotate every micro-batch with the batch operators; returns the running query.

    A batch id names its own output folder, so a batch that is repeated after a failure
    overwrites its own result.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        done = to_json_documents(kept, annotate(kept, **stages))
        done.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        kept.unpersist()

    return (docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
