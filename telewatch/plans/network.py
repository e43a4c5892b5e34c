"""Availability pipeline over the event-log network: states -> events -> windows -> classified events."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telewatch.operators import availability as A
from telewatch.operators import states as R
from telewatch.sources import event_log
from telewatch.sources.tables import materialise

MIN_STATIONS, WINDOW_HOURS, MIN_ACTIVE = 6, 1, 10


@dataclass(frozen=True)
class Network:
    """Lazy tables of one network; each is a plan, built once and shared by the tables that follow from it."""

    spark: SparkSession
    folder: str

    @cached_property
    def bins(self) -> DataFrame:
        return event_log.hourly(self.spark, self.folder)

    @cached_property
    def registry(self) -> DataFrame:
        return event_log.registry(self.spark, self.folder, self.bins)

    @cached_property
    def hours(self) -> DataFrame:
        return event_log.station_hours(self.spark, self.folder, self.bins)

    @cached_property
    def states(self) -> DataFrame:
        return R.classify(self.hours)

    @cached_property
    def stored_states(self) -> DataFrame:
        """States written once, for plans that read them several times."""
        return materialise(self.states, "hourly_row_states")

    @cached_property
    def enriched(self) -> DataFrame:
        return R.enrich_registry(self.stored_states, self.registry)

    @cached_property
    def audit(self) -> DataFrame:
        return R.audit_summary(self.stored_states, self.enriched)

    @cached_property
    def raw_events(self) -> DataFrame:
        return A.outage_events(self.states)

    @cached_property
    def stored_events(self) -> DataFrame:
        """Outage events written once: windows, members and classes all start from them."""
        source = self.stored_states if "stored_states" in self.__dict__ else self.states
        return materialise(A.outage_events(source), "availability_events")

    @cached_property
    def windows(self) -> DataFrame:
        return A.network_windows(self.stored_events, MIN_STATIONS, WINDOW_HOURS)

    @cached_property
    def stored_windows(self) -> DataFrame:
        return materialise(self.windows, "network_outage_windows")

    @cached_property
    def members(self) -> DataFrame:
        return A.window_members(self.stored_events, self.stored_windows)

    @cached_property
    def events(self) -> DataFrame:
        return A.classify_events(self.stored_events, self.windows)

    @cached_property
    def reliability(self) -> DataFrame:
        freeze = self.bins.agg(F.date_add(F.to_date(F.max("hour_utc")), 1).cast("timestamp").alias("freeze")).scalar()  # the end of the last day
        audit = self.audit  # stores the states, which the events then start from
        return A.station_reliability(self.registry, audit, self.events, freeze)
