"""Continuous import, beyond the batch engine: micro-batches of a document stream become versions of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gleanspark.plans.engine import Engine


def import_stream(engine: Engine, documents: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Imports each micro-batch of (title, source, content, metadata, import_seq).

    Importing a batch again replaces its own documents by key, so a batch repeated after a failure changes nothing.
    """
    writer = documents.writeStream.foreachBatch(lambda batch, _: engine.import_documents(batch) and None).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
