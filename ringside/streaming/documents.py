"""Event documents taken in as they arrive in a folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ringside.plans import ingest
from ringside.schema import EVENT_DOCUMENT
from ringside.sources import files
from ringside.sources.store import TableStore


def follow_events(spark: SparkSession, arrivals: str, fighters: str, stats: str, tables: str, checkpoint: str) -> StreamingQuery:
    """Merge the event documents that arrive in ``arrivals`` into the store at ``tables``; ends when all that is there is taken in.

    fighters and stats hold the documents of fighters and of bout statistics that events refer to.  A batch appends the rows that are
    new, wholly or not at all; as every load is get-or-create, a batch that is run again after a failure changes nothing.
    """
    events, store = spark.readStream.schema(EVENT_DOCUMENT).option("multiLine", True).json(arrivals), TableStore(spark, tables)

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select("event_id", F.col("name").alias("event_name"), F.col("date").alias("event_date"), F.explode("bouts").alias("bout"))
        slugs = rows.select(F.explode("bout.corners").alias("c")).select("c.slug").distinct()
        known = files.fighter_documents(spark, fighters).join(slugs, "slug", "left_semi")
        bouts = files.bout_stats_documents(spark, stats).join(rows.select("bout.bout_id").distinct(), "bout_id", "left_semi")
        store.update(lambda view: ingest.event_rows_to_add(ingest.tables_for(view, rows, known), rows, known, bouts, last=view.last_ids()), f"{number:09d}-{uuid.uuid4().hex}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
