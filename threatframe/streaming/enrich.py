"""Streaming ingest: parse, normalize and enrich the lines of a micro-batch as the batch job does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatframe.functions.staging import spread, staged, temporary
from threatframe.operators import indicators, joins, normalize
from threatframe.sources import formats


def enriched(lines: DataFrame, ranges: DataFrame, feed: DataFrame, reference: Column, line: str = "line") -> DataFrame:
    """Events of lines: parsed and normalized, with iocs, pii_detected (types), geo_src and geo_dst (country, kind), and the
    first of source and target that the feed knows (matched, threat_type, verdict, risk). One row per line."""
    events = normalize.normalize(formats.parsed(spread(lines), line), reference, line)
    text = F.col(line)
    events = events.withColumns({"iocs": indicators.iocs(text), "pii_detected": F.array_sort(F.array_distinct(F.transform(indicators.personal(text), lambda h: h.type))), "risk": F.lit(0)})
    events = staged(events, "normalized")  # three joins go out from it, which must not parse again
    places = joins.located(joins.both_ends(events), ranges)
    for c, name in (("src_ip", "geo_src"), ("dst_ip", "geo_dst")):
        events = joins.geo_lookup(events, ranges, c, places).withColumn(name, F.struct("country", "kind")).drop("country", "kind")
    return joins.intel_match(events, feed, ["src_ip", "dst_ip"], "dedup_event_id")


class Ingest:
    """The body of a foreachBatch that appends enriched events to a folder.

    ranges and feed are called for every batch, so that a reference table that has changed counts from the next batch on. A
    batch that comes again after a failure replaces what it wrote.
    """

    def __init__(self, path: str, ranges: Callable[[], DataFrame], feed: Callable[[], DataFrame], reference: Column, line: str = "line"):
        self.path, self.ranges, self.feed, self.reference, self.line = path, ranges, feed, reference, line

    def apply(self, batch: DataFrame, number: int) -> None:
        with temporary(batch.sparkSession):
            out = enriched(batch, self.ranges(), self.feed(), self.reference, self.line)
            out.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
