"""Streams of relationships: micro-batches append to a relationship table, once each."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.catalog import Catalog
from tessera.operators.writes import add_rels
from tessera.session import GraphSession


def append_rels(session: GraphSession, table: str, stream: DataFrame, source_column: str, target_column: str, checkpoint: str):
    """A started streaming query that appends each micro-batch of stream to the table.

    The two columns hold keys of the endpoint tables, as in register_rels; rows whose ends don't both exist are left out.
    A batch is one write like any other. Its number becomes part of the version that it makes, under the checkpoint's
    name, so a batch that comes again, after a restart too if the session has a folder, is left out.
    """
    name = f"{table}@{checkpoint}"

    def apply(batch: DataFrame, number: int) -> None:
        def change(catalog: Catalog) -> Catalog:
            if catalog.applied.get(name, -1) >= number:
                return catalog
            rel = catalog.rel(table)
            rows = batch
            for column, end, offset in ((source_column, rel.source, "_src"), (target_column, rel.target, "_dst")):
                nodes = catalog.node(end)
                rows = rows.join(nodes.rows.select(F.col(f"`{nodes.key}`").alias("#key"), F.col("_id").alias(f"#{offset}")), F.col(f"`{column}`") == F.col("#key")).drop("#key")
            new = rows.select(F.col("#_src").alias("_src"), F.col("#_dst").alias("_dst"), *[f"`{c}`" for c in rel.columns if c in batch.columns])
            return replace(catalog.put(add_rels(rel, new)), applied={**catalog.applied, name: number})

        session.commit(change, wait=True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
