"""Append a stream to an engine table, batch by batch.

Each micro-batch is one INSERT with its constraint checks. A table beside the target remembers the last
batch of each stream; both change in one transaction, so a batch that is delivered again is not inserted
again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.engine.session import Engine


def append_stream(stream: DataFrame, engine: Engine, table: str, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that inserts ``stream`` into ``table``; ``trigger`` as for writeStream.trigger."""

    def put(batch: DataFrame, number: int) -> None:
        view = f"quern_batch_{table}"
        with engine.connect() as session:
            session.execute("CREATE TABLE IF NOT EXISTS stream_progress (name TEXT PRIMARY KEY, batch BIGINT)")
            batch.createOrReplaceGlobalTempView(view)
            with session.begin():
                done = session.execute(f"SELECT batch FROM stream_progress WHERE name = '{name}'").rows()
                if done and done[0][0] >= number:
                    return
                session.execute(f"INSERT INTO {table} ({', '.join(batch.columns)}) SELECT * FROM global_temp.{view}")
                session.execute(f"UPDATE stream_progress SET batch = {number} WHERE name = '{name}'" if done else f"INSERT INTO stream_progress VALUES ('{name}', {number})")

    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**trigger).start()
