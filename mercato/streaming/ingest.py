"""Loading a growing folder: Structured Streaming finds the new files, the key check does the rest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mercato.operators.keys import ARRIVAL, arrival_columns
from mercato.operators.upsert import insert_if_absent
from mercato.plans.clean import clean
from mercato.schemas import TABLES
from mercato.session import configure, shuffles_removed
from mercato.sources.store import Store
from mercato.streaming.parked import insert_or_park


def stream_into(
    arriving: DataFrame, table: str, parents: Mapping[str, DataFrame] | None, store: Store, checkpoint: str
) -> StreamingQuery:
    """Clean and insert every micro-batch of a raw streaming table, then stop.

    ``arriving`` carries the arrival order of its files; inside a file the order of rows is added
    here, where a micro-batch still has the partitions of its scan. A batch that is replayed after a failure
    inserts nothing twice: its keys are in the store by then.

    With ``parents`` a row without one is dropped. Without, the parents are those that the store holds when the batch
    comes, and a row that lacks one is parked until it is there, so the tables can arrive in any order.
    """
    declared = TABLES[table]

    def load(batch: DataFrame, batch_id: int) -> None:
        # A stream runs in a session of its own.
        configure(batch.sparkSession)
        last = f"{ARRIVAL}{len(arrival_columns(batch))}"
        batch = batch.withColumn(last, F.monotonically_increasing_id())
        # The store's reads and writes are in its own session, the batch in another.
        with shuffles_removed(batch.sparkSession), shuffles_removed(store.spark):
            if parents is None:
                insert_or_park(batch, table, store)
            else:
                insert_if_absent(clean(table, batch, parents), store, table, declared.key, declared.unique)

    return (
        arriving.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
