"""The tables an operator may ask for, derived lazily from raw events or read from storage."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from opsight.operators.routing import ROUTES
from opsight.schemas import ACTION, AGENT, APPROVAL, INVENTORY, KITCHEN, ORDERS, RAW, STATIONS
from opsight.sources import manifest
from opsight.sources.stations import read_stations, stations
from opsight.sources.tables import read_table


class OpsTables:
    """Each table is built when it is first asked for, so a query plans only what it reads."""

    def __init__(self, source: Callable[[str], DataFrame]):
        self._source = source

    @classmethod
    def from_raw(cls, raw: DataFrame, reference: DataFrame | None = None) -> OpsTables:
        """Derive the operational tables from raw events; nothing runs until a result is asked for."""

        def derive(name: str) -> DataFrame:
            if name == STATIONS:
                return reference if reference is not None else stations(raw.sparkSession)
            return raw if name == RAW else ROUTES[name](raw)

        return cls(derive)

    @classmethod
    def stored(cls, spark: SparkSession, root: str) -> OpsTables:
        """Tables written by `fan_out` and `write_stations`, all as of one state of the manifest."""
        state = manifest.state(spark, root)
        return cls(lambda name: read_stations(spark, root) if name == STATIONS else read_table(spark, root, name, state=state))

    def by_name(self, name: str) -> DataFrame:
        return self._source(name)

    raw = cached_property(lambda self: self.by_name(RAW))
    orders = cached_property(lambda self: self.by_name(ORDERS))
    kitchen = cached_property(lambda self: self.by_name(KITCHEN))
    inventory = cached_property(lambda self: self.by_name(INVENTORY))
    agent = cached_property(lambda self: self.by_name(AGENT))
    approval = cached_property(lambda self: self.by_name(APPROVAL))
    action = cached_property(lambda self: self.by_name(ACTION))
    stations = cached_property(lambda self: self.by_name(STATIONS))
