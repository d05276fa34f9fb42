"""Keep an index up to date from a stream of file versions.

The index build is incremental already; here Structured Streaming finds the new rows and
each micro-batch updates the index once. A batch that is run again after a failure finds
its files unchanged and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodebook.plans.index import Index
from lodebook.session import materialize
from lodebook.sources.filetree import with_derived

def upsert(index: Index, batch: DataFrame) -> None:
    """The newest version per path wins; files that are not in the batch stay, and their texts are not read."""
    newest = batch.groupBy("path").agg(F.max_by(F.struct(*batch.columns), "last_modified").alias("v")).select("v.*")
    index.build(materialize(with_derived(newest), "arrived"), whole=False)


def keep_indexed(versions: DataFrame, index: Index, checkpoint: str, **trigger):
    """Start the query. `versions` streams (path, relative_path, content, size, last_modified)."""
    return (
        versions.writeStream.foreachBatch(lambda batch, _: upsert(index, batch))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
