"""A catalogue that follows a stream of changed rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.maintain import last_writer, upsert


def follow(changes: DataFrame, read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Puts each micro-batch of symbol rows over the catalogue.

    ``read`` gives the catalogue as it is and ``write`` replaces it. A batch that is run again after a
    failure puts the same rows over the same names, so the outcome is the same.
    """

    def apply(batch: DataFrame, _: int) -> None:
        old = read()
        write(last_writer(batch, "qualified_name", "seq") if old is None else upsert(old, batch))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
