"""A lazy view of one history: privacy, then period, then zones, then the question."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from geotrail.functions.text import MOST_ZOOM, MOST_ZOOM_PRIVATE
from geotrail.operators import aggregates as A
from geotrail.operators import days as D
from geotrail.operators import filters as L


@dataclass(frozen=True)
class History:
    """Tables and the steps that apply to them; every step returns a new view, every question a DataFrame.

    Coverage and statistics ignore zones; rankings, routes and day views heed them.
    """

    visits: DataFrame
    activities: DataFrame
    path_points: DataFrame
    frequent_places: DataFrame
    prefectures: DataFrame | None = None
    municipalities: DataFrame | None = None
    zone_table: DataFrame | None = None
    private: bool = False
    when: tuple = field(default=(None, None))
    cumulative: bool = False

    def privacy(self, on: bool = True) -> "History":
        return replace(self, private=on)

    def period(self, year: int | None = None, month: int | None = None) -> "History":
        return replace(self, when=(year, month), cumulative=False)

    def up_to(self, year: int, month: int) -> "History":
        return replace(self, when=(year, month), cumulative=True)

    def zones(self, table: DataFrame | None) -> "History":
        return replace(self, zone_table=table)

    def _timed(self, df: DataFrame) -> DataFrame:
        return L.up_to_period(df, *self.when) if self.cumulative else L.in_period(df, *self.when)

    def _hidden(self, df: DataFrame, places: list[tuple[str, str]]) -> DataFrame:
        return L.apply_privacy(df, self.frequent_places, places) if self.private else df

    def stays(self, display: bool = False) -> DataFrame:
        """Stays after privacy and period; for display also outside the zones."""
        v = self._timed(self._hidden(self.visits, [("lat", "lng")]))
        return L.exclude_zones(v, self.zone_table) if display and self.zone_table is not None else v

    def moves(self) -> DataFrame:
        """Moves after privacy and period; zones never remove moves."""
        return self._timed(self._hidden(self.activities, [("start_lat", "start_lng"), ("end_lat", "end_lng")]))

    def points(self) -> DataFrame:
        """Path points after privacy and period."""
        return self._timed(self._hidden(self.path_points, [("lat", "lng")]))

    def stats(self) -> DataFrame:
        """Travel by mode."""
        return A.travel_by_mode(self.moves())

    def first_level(self) -> DataFrame:
        """Coverage of first-level regions."""
        return A.first_level_coverage(self.stays(), self.points(), self.prefectures)

    def second_level(self) -> DataFrame:
        """Coverage of second-level regions."""
        return A.second_level_coverage(self.stays(), self.points(), self.municipalities)

    def newly_visited(self, year: int) -> DataFrame:
        """First-level regions first visited in a year, over the whole history."""
        return A.newly_visited(replace(self, when=(None, None), cumulative=False).first_level(), year)

    def ranking(self, sort_by: str = "visits", limit: int | None = 50) -> DataFrame:
        """Stay points, or under privacy only regions."""
        v = self.stays(display=True)
        return A.region_ranking(v, sort_by) if self.private else A.place_ranking(v, sort_by, limit)

    @property
    def closest_zoom(self) -> int:
        """How far a map of this view may be drawn in."""
        return MOST_ZOOM_PRIVATE if self.private else MOST_ZOOM

    def year_options(self) -> DataFrame:
        """The years that the history has, whatever the period."""
        return D.year_options(self.visits, self.path_points)

    def region_summaries(self) -> DataFrame:
        """What is said of each second-level region, and why it has no stays if it has none."""
        return A.region_summaries(self.second_level(), self.stays(display=True))

    def longest_trips(self, limit: int = 10) -> DataFrame:
        """The longest moves."""
        return A.longest_trips(self.moves(), limit)
