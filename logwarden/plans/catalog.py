"""All registered queries and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import events as ev, geo
from ..sources import loglines as ll
from . import decision_queries, event_queries, file_queries, ml_queries, network_queries, weblog_queries  # noqa: F401
from .registry import ORACLES, QUERIES, flat
from .views import AS_OF, Tables

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web log lines to classified events, placed and ranked by source."""
    t = Tables(spark, sf_dir)
    found = ll.access_events(ll.parse_access(t.access_lines))
    placed = geo.geo_enrich(found, t.geo_ranges, "source_ip")
    return flat(ev.top_threats(placed, t.predictions, AS_OF, hours=24 * 30, limit=50))
