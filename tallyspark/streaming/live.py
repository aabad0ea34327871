"""The stateless and group-by part of queries over streaming DataFrames: a request compiled onto readStream instead of a scan."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.columns import name
from ..operators.frames import Grouped, prepared
from ..plans.logical import Limits, Planner
from ..plans.request import Query
from ..sources.catalog import normalized
from ..types import Scales


def streaming_query(df: DataFrame, query: Any, *, event_time: str | None = None, watermark: str | None = None, window: str | None = None, functions: Mapping | None = None, aggregates: Mapping | None = None) -> DataFrame:
    """Filter, derive and select, or filter, derive and group (by event-time windows too, as column `window`), over a
    streaming DataFrame. Late data beyond the watermark is dropped, and state for closed windows with it. What needs all
    rows (total(), rollup, pivot, sort, page) is refused."""
    q = query if isinstance(query, Query) else Query.read(query, "/query")
    for part in ("rollup", "pivot", "sort", "page"):
        if getattr(q, part):
            raise SpecError(f"{part} needs all rows, which a stream never has", "invalid_request", f"/query/{part}")
    frame, types = normalized(df)
    if event_time is not None:
        frame = frame.withColumn(event_time, name(event_time).cast("timestamp"))
        if watermark is not None:
            frame = frame.withWatermark(event_time, watermark)
    plan = Planner(types, tuple(types), Scales(), Limits(), functions or {}, aggregates or {}).plan(q)
    rows = prepared(frame, plan)
    if plan.group is None:
        return rows.select(*[name(c) for c in plan.output])
    if plan.totals:
        raise SpecError("total() needs all rows, which a stream never has", "invalid_total", "/query/post")
    if window is None:
        grouped = Grouped(rows, plan)
        return grouped.finish(grouped.finest, plan.keys, None)
    if event_time is None:
        raise SpecError("windows need an event time", "invalid_request")
    timed = Grouped(rows.withColumn("window", F.window(name(event_time), window)), plan, first=("window",))
    return timed.finish(timed.finest, ("window", *plan.keys), None)
