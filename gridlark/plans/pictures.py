"""Raw streams of a data set, their enriched forms, and the plans that combine several domains."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from gridlark.operators import alerts as A
from gridlark.operators import enrich as N
from gridlark.operators import joins as J
from gridlark.operators import state as S
from gridlark.operators import windows as W
from gridlark.plans.profiles import ALERTS, MERGED_ALERTS
from gridlark.sources import feeds


class Domain:
    """Lazily built DataFrames of one data set under one profile. Nothing is executed here."""

    def __init__(self, spark: SparkSession, sf_dir: str, profile: str = "classic"):
        self.spark, self.sf_dir, self.profile = spark, sf_dir, profile

    def raw(self, stream: str) -> DataFrame:
        return getattr(feeds, f"{stream}_raw")(self.spark, self.sf_dir)

    def _timed(self, stream: str) -> DataFrame:
        return W.with_event_time(self.raw(stream))

    @cached_property
    def gps(self) -> DataFrame:
        return N.enrich_gps(self._timed("gps"), self.profile)

    @cached_property
    def aircraft(self) -> DataFrame:
        return N.enrich_aircraft(self._timed("aircraft"), self.profile)

    @cached_property
    def sigint(self) -> DataFrame:
        return N.enrich_sigint(self._timed("sigint"), self.profile)

    @cached_property
    def satellite(self) -> DataFrame:
        return N.enrich_satellite(self._timed("satellite"), self.profile)

    @cached_property
    def naval(self) -> DataFrame:
        return N.enrich_naval(self._timed("naval"), "current")

    @cached_property
    def cyber(self) -> DataFrame:
        return N.enrich_cyber(self._timed("cyber"), "current")

    @cached_property
    def embm(self) -> DataFrame:
        return N.enrich_embm(self._timed("embm"), "current")

    @cached_property
    def jsir(self) -> DataFrame:
        if self.profile == "clean":  # this generation alerts on the raw stream
            return self.raw("jsir")
        return N.enrich_jsir(self._timed("jsir"))

    @cached_property
    def gps_latest(self) -> DataFrame:
        return S.gps_latest(self.raw("gps"), "clean" if self.profile == "clean" else "setup")

    @cached_property
    def threat_zone(self) -> DataFrame:
        return J.units_in_threat(self.gps, W.active_threats(self.sigint, self.profile))

    def alert(self, name: str) -> DataFrame:
        rule = ALERTS[self.profile][name]
        return A.alert(getattr(self, rule.source), rule)

    def all_alerts(self) -> DataFrame:
        """The merged alert stream: one scan per source, whatever the number of rules."""
        by_source: dict[str, list] = {}
        for name in MERGED_ALERTS[self.profile]:
            rule = ALERTS[self.profile][name]
            by_source.setdefault(rule.source, []).append(rule)
        out = None
        for source, rules in by_source.items():
            part = A.alerts_one_pass(getattr(self, source), rules)
            out = part if out is None else out.unionByName(part)
        return out

    def operational_picture(self) -> DataFrame:
        return J.operational_picture(
            W.grid_force(self.gps, "classic"),
            W.grid_threat(self.sigint, "classic"),
            W.grid_isr(self.satellite, "classic"),
            self.profile,
        )

    def isr_gaps(self) -> DataFrame:
        return J.isr_gaps(W.grid_force(self.gps, "classic"), W.grid_isr(self.satellite, "classic"))

    def tracks(self) -> DataFrame:
        latest = self.gps_latest
        return J.unified_tracks(
            self.raw("gps"),
            J.aircraft_with_gps(self.raw("aircraft"), latest, self.profile),
            J.naval_with_gps(self.raw("naval"), latest, self.profile),
        )
