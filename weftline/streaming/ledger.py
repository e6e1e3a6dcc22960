"""Licence commands as a stream: one ledger, by batch, from which status, audit and events are read.

A batch is written by its number, overwriting what an earlier attempt at it left, and acts on what the
batches before it left. So a replay writes the same rows again, and no reader sees a status without its audit row.
Late commands act after those of earlier batches, whatever their time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators import transitions


def outcomes(licenses: DataFrame, path: str) -> DataFrame:
    return licenses.sparkSession.read.parquet(path)


def current(licenses: DataFrame, path: str, before: int | None = None) -> DataFrame:
    """Licences after all batches, or after those below `before`."""
    done = outcomes(licenses, path)
    return transitions.current(licenses, done if before is None else done.filter(F.col("batch") < before), ("batch", "at", "command_id"))


def write_batch(licenses: DataFrame, commands: DataFrame, path: str, batch: int) -> None:
    if batch == 0:
        transitions.apply(licenses, commands.limit(0)).write.mode("overwrite").parquet(f"{path}/batch=-1")  # gives the folder its schema
    transitions.apply(current(licenses, path, batch), commands).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def run(licenses: DataFrame, commands: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream over what is there now; batches follow those that the checkpoint has."""
    return commands.writeStream.foreachBatch(lambda b, n: write_batch(licenses, b, path, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
