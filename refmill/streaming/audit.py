"""The audit of a folder that texts keep arriving in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from refmill.plans.audit import audit_parsed
from refmill.sources.files import citations_of


def audit_stream(spark: SparkSession, folder: str, candidates: DataFrame, out: str, state: str, once: bool = True) -> StreamingQuery:
    """Audits each new .txt or .md file of folder against candidates and adds flat results to the table at out; state holds what was read, so a restart goes on.

    Each batch is one plan over whole files; once: stop when all that is there has been read.
    """
    texts = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", 1000).load(folder).select(F.input_file_name().alias("path"), F.col("value").alias("text"))

    def run(batch: DataFrame, number: int) -> None:
        rows = citations_of(batch, "path", "text").withColumn("id_", F.xxhash64("path", "ordinal"))
        # a batch run again after a failure writes its own folder again
        audit_parsed(rows, candidates, "id_").write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = texts.writeStream.foreachBatch(run).option("checkpointLocation", state)
    return (query.trigger(availableNow=True) if once else query).start()
