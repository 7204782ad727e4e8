"""Incremental ingest of arriving files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docmill import schemas as S
from docmill.jobs.ingest import ingest_batch
from docmill.sources.corpus import HASHES, known_documents, publish
from docmill.sources.scratch import forget


def stream_ingest(spark: SparkSession, source: str, root: str, checkpoint: str, created_at: str) -> StreamingQuery:
    """Ingest Parquet files of received rows as they arrive, each micro-batch as one version with its
    documents, chunks and rejected files.

    The corpus is the state. A batch that is replayed writes its version again, and reads the corpus
    without it: else its own rows would make it empty. Of the corpus it reads the parts of the hash index that may hold one
    of its hashes.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        def known(hashes: DataFrame) -> DataFrame:
            try:
                return known_documents(spark, root, hashes, without_version=str(batch_id))
            except AnalysisException as fault:
                if fault.getCondition() != "PATH_NOT_FOUND":  # the first batch finds no corpus
                    raise
                return spark.createDataFrame([], HASHES)

        kept: list[DataFrame] = []
        documents, chunks, rejected = ingest_batch(batch, known, created_at, kept=kept)
        publish(documents, chunks, root, str(batch_id), rejected)
        for table in kept:
            forget(table)

    stream = spark.readStream.schema(S.RECEIVED).option("maxFilesPerTrigger", 64).parquet(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
