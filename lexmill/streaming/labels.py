"""Incremental forms of two append-only steps: the label cache and the judging pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.sources.files import append_only_new


def label_stream(spark: SparkSession, source: str, schema: str) -> DataFrame:
    """New label files as a stream."""
    return spark.readStream.schema(schema).json(source)


def start_label_cache(labels: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append each key once, however late it comes again: every batch is held against the sink, so no state grows with the
    keys and a batch that is run again after a failure adds nothing.  Of a key's rows in one batch the first by all columns counts."""

    def batch(rows: DataFrame, _number: int) -> None:
        others = [c for c in rows.columns if c != "key"]
        once = rows.groupBy("key").agg(F.min(F.struct(*others)).alias("r")).select("key", "r.*").select(*rows.columns)
        append_only_new(once, sink, "key").write.mode("append").parquet(sink)

    return labels.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_unjudged(pool: DataFrame, judged_path: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Pooled rows nobody has judged yet, against the judgements as each batch finds them."""

    def batch(rows: DataFrame, _number: int) -> None:
        judged = rows.sparkSession.read.parquet(judged_path).select("qid", "doc_id")
        rows.join(judged, ["qid", "doc_id"], "left_anti").write.mode("append").parquet(sink)

    return pool.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
