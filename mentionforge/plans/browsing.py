"""Small look-ups over the entity table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def browse(entities: DataFrame, entity_type: str | None = None, limit: int = 50) -> DataFrame:
    """The first entities by id, of one type if given; the limit is a report's, between 1 and 200."""
    rows = entities if entity_type is None else entities.where(entities["entity_type"] == entity_type)
    return rows.select("entity_id", "entity_type", "entity_name").orderBy("entity_id").limit(max(1, min(200, limit)))
