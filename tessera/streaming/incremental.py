"""Incremental forms: the chunk index and the pending-orphan state, fed by file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.orphans import COUNTED, REFERENCES, VERSIONS, State, advance, empty_state, reported
from tessera.operators.retrieval import chunk_fixed
from tessera.session import discard, materialize


def index_stream(docs: DataFrame, path: str, checkpoint: str, size: int = 900, over: int = 120, id: str = "doc_id", text: str = "text", collection: str = "collection") -> StreamingQuery:
    """Chunks of new documents go to the index, by collection; everything there is, then it ends."""
    labels = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.coalesce(collection, F.lit("none")).alias("collection"))

    def put(batch: DataFrame, no: int) -> None:
        rows = chunk_fixed(batch, size, over).join(batch.select("id", "collection"), "id")
        # A batch that is repeated after a failure overwrites its own folder.
        rows.write.mode("overwrite").partitionBy("collection").parquet(f"{path}/batch={no}")

    return labels.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def orphan_stream(events: DataFrame, folder: str, checkpoint: str, ref_tables: list[str]) -> StreamingQuery:
    """``events(kind, ref_table, key, ts, row_id, deleted)`` of parents and references, late rows
    included. Each batch appends its own rows, orphans, retractions, counts and snapshots as
    ``folder``/<name>/batch=n; a repeated batch reads the batches before it and overwrites its own."""

    def step(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        kept = lambda name, schema: spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/{name}").where(F.col("batch") < no).drop("batch")
        state = State(kept("versions", VERSIONS), kept("refs", REFERENCES), kept("counts", COUNTED)) if no else empty_state(spark)
        rows = batch.where("key is not null").persist()
        parents = rows.where("kind = 'parent'").groupBy("key", "ts").agg(F.max("row_id").alias("seq"), F.max_by(~F.coalesce("deleted", F.lit(False)), "row_id").alias("alive"))
        refs = rows.where("kind = 'reference'").select("ref_table", "key", "ts", "row_id")
        done = advance(state, parents, refs, ref_tables)
        changes = materialize(done.changes, "changes")
        out = {"versions": parents, "refs": refs, "orphans": reported(changes), "retracted": reported(changes, -1), "counts": done.counts(), "snapshots": done.snapshots()}
        for name, df in out.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={no}")
        rows.unpersist()
        discard(changes)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
