"""Event catalogs: tables with event_id and t, and for intervals t0, t1 and duration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siglake.operators.graph import checkpointed

FAMILIES = ("burst", "ripple", "spindle", "wave", "generic")
SCORES = ("score", "amp", "amplitude", "power", "peak_amp", "peak_power")


@dataclass
class EventCatalog:
    """An event table with its label-free metadata; intervals get their duration."""

    table: DataFrame
    metadata: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        missing = {"event_id", "t"} - set(self.table.columns)
        if missing:
            raise ValueError(f"an event catalog needs {sorted(missing)}")
        if self.is_intervals and "duration" not in self.table.columns:
            self.table = self.table.withColumn("duration", F.col("t1") - F.col("t0"))

    @property
    def is_intervals(self) -> bool:
        return {"t0", "t1"} <= set(self.table.columns)

    def to_records(self, most: int = 20_000) -> DataFrame:
        """A JSON record of each event, for viewers; none if there are more than they take."""
        few = self.table.limit(most + 1).count() <= most
        return self.table.select(F.to_json(F.struct(*sorted(self.table.columns))).alias("record")).where(F.lit(few))

    def to_events(self) -> DataFrame:
        return self.table.select("t", *[c for c in ("label",) if c in self.table.columns])

    def to_intervals(self) -> DataFrame:
        if not self.is_intervals:
            raise ValueError("these events have no intervals")
        return self.table.select("t0", "t1")

    def to_point_intervals(self, half_window: float) -> DataFrame:
        return self.table.select((F.col("t") - half_window).alias("t0"), (F.col("t") + half_window).alias("t1"))

    def _where(self, keep: Column) -> EventCatalog:
        return EventCatalog(self.table.where(keep), self.metadata)

    def filter_by_time(self, t_min: float, t_max: float) -> EventCatalog:
        """Closed at both ends, in either order."""
        return self._where(F.col("t").between(min(t_min, t_max), max(t_min, t_max)))

    def filter_by_channel(self, channels: list) -> EventCatalog:
        return self._where(F.col("channel").isin(list(channels)))

    def filter_by_spatial(self, ap: float | None = None, ml: float | None = None, radius: float | None = None) -> EventCatalog:
        """Within radius of (ap, ml); without a radius, of this ap (ml is then not looked at), or of this ml."""
        if None not in (ap, ml, radius):
            return self._where(F.hypot(F.col("AP") - ap, F.col("ML") - ml) <= radius)
        if ap is not None:
            return self._where(F.col("AP") == ap)
        return self._where(F.col("ML") == ml) if ml is not None else self

    def following(self, t: float) -> DataFrame:
        return self.table.where(F.col("t") > t).orderBy("t", "event_id").limit(1)

    def preceding(self, t: float) -> DataFrame:
        return self.table.where(F.col("t") < t).orderBy(F.desc("t"), F.desc("event_id")).limit(1)

    def by_id(self, event_id) -> DataFrame:
        return self.table.where(F.col("event_id") == event_id).limit(1)


def numbered(df: DataFrame, prefix: str, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """event_id prefix_000000 and so on in this order, anew for each key.

    Without keys the events are sorted in ranges and numbered from the count of the ranges before; counts by range reach the
    driver. The sorted events are checkpointed, as ranges are sampled and would differ from run to run.
    """
    if keys:
        n = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
        return df.withColumn("event_id", F.format_string(f"{prefix}_%06d", n))
    own = checkpointed(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))  # range in the upper bits, place in the lower 33
    own = own.withColumn("__range", F.shiftright("__at", 33))
    before, starts = 0, []
    for r in own.groupBy("__range").count().orderBy("__range").collect():
        starts.append((r["__range"], before))
        before += r["count"]
    start = df.sparkSession.createDataFrame(starts, "__range long, __start long")
    n = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return own.join(F.broadcast(start), "__range").withColumn("event_id", F.format_string(f"{prefix}_%06d", n)).drop("__at", "__range", "__start")


def from_start_peak_end(rows: DataFrame, label: str = "ripple", keys: list[str] | None = None, order: list[str] | None = None) -> EventCatalog:
    """Catalog of detections that come as start, peak and end, with peak_amplitude as value if it is there."""
    if missing := {"start", "peak", "end"} - set(rows.columns):
        raise ValueError(f"missing {sorted(missing)}")
    value = [F.col("peak_amplitude").cast("double").alias("value")] if "peak_amplitude" in rows.columns else []
    named = [c for c in rows.columns if c not in ("start", "peak", "end", "peak_amplitude")]
    own = rows.select(*named, *[F.col(c).cast("double").alias(t) for c, t in (("peak", "t"), ("start", "t0"), ("end", "t1"))], F.lit(label).alias("label"), *value)
    return EventCatalog(numbered(own, label, order or ["t0", "t"], keys))


def scored(df: DataFrame) -> DataFrame:
    """score: the first of the known names that is there, else 1."""
    found = [F.col(c).cast("double") for c in SCORES if c in df.columns]
    return df.withColumn("score", F.coalesce(*found, F.lit(1.0)))


def violations(table: DataFrame, memberships: DataFrame | None = None) -> DataFrame:
    """rule, n: how many rows break each rule of the strict catalog."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    same_id = table.groupBy("event_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate_id").alias("rule"), F.col("n").cast("long"))
    rules: dict[str, Column] = {f"finite_{c}": ~finite(c) for c in ("t", "t0", "t1", "duration", "score") if c in table.columns}
    rules |= {"ends_after_start": ~(F.col("t1") > F.col("t0")), "t_inside": ~F.col("t").between(F.col("t0"), F.col("t1")), "duration_agrees": ~(F.abs(F.col("duration") - (F.col("t1") - F.col("t0"))) < 1e-6)}
    counts = table.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()])
    out = counts.unpivot([], list(rules), "rule", "n").unionByName(same_id)
    if memberships is not None:
        lost = memberships.join(table.select("event_id"), "event_id", "left_anti").agg(F.count("*").alias("n"))
        out = out.unionByName(lost.select(F.lit("unknown_member").alias("rule"), "n"))
    return out


class EventRegistry:
    """Catalogs by name."""

    def __init__(self) -> None:
        self.catalogs: dict[str, EventCatalog] = {}

    def register(self, name: str, catalog: EventCatalog) -> None:
        self.catalogs[name] = catalog

    def get(self, name: str) -> EventCatalog | None:
        return self.catalogs.get(name)

    def names(self) -> list[str]:
        return list(self.catalogs)

    def remove(self, name: str) -> None:
        self.catalogs.pop(name, None)


def each(catalogs: dict[str, EventCatalog], f: Callable[[DataFrame], DataFrame]) -> dict[str, EventCatalog]:
    return {n: EventCatalog(f(c.table), c.metadata) for n, c in catalogs.items()}
