"""Dimensions, levels, cuboids and views of the sales cube."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from itertools import product


@dataclass(frozen=True)
class Level:
    name: str
    sql: str
    kind: str
    label: str | None = None  # column that names the level's values


@dataclass(frozen=True)
class Dimension:
    name: str
    levels: tuple[Level, ...]  # coarse to fine; above them all values together

    def index(self, level: str) -> int:
        return next(i for i, x in enumerate(self.levels) if x.name == level)


DIMENSIONS = (
    Dimension("customer_location", (Level("c_region_id", "n_regionkey", "long", "c_region_name"), Level("c_nation_id", "c_nationkey", "long", "c_nation_name"))),
    Dimension("product", (Level("product_id", "l_partkey", "long", "product_name"),)),
    Dimension(
        "time",
        (
            Level("o_year", "year(o_orderdate)", "int"),
            Level("o_yearmonth", "year(o_orderdate) * 100 + month(o_orderdate)", "int"),
            Level("o_date", "cast(o_orderdate as date)", "date"),
        ),
    ),
)
BY_NAME = {d.name: d for d in DIMENSIONS}
LEVELS = {x.name: x for d in DIMENSIONS for x in d.levels}


def cuboids() -> list[tuple[str, ...]]:
    """All combinations of one level, or none, of each dimension; each sorted by name."""
    return [tuple(sorted(x for x in combo if x)) for combo in product(*((None, *(x.name for x in d.levels)) for d in DIMENSIONS))]


def is_stored(levels: tuple[str, ...]) -> bool:
    """Products by month or date are too many to store."""
    return not ("product_id" in levels and ("o_yearmonth" in levels or "o_date" in levels))


#: What names of stored cuboids, and of those made on the fly, begin with.
STORED_PREFIX, VIRTUAL_PREFIX = "cube_results_T__", "cube_results_V__"


def cuboid_name(levels: tuple[str, ...]) -> str:
    return (STORED_PREFIX if is_stored(levels) else VIRTUAL_PREFIX) + ("__".join(sorted(levels)) or "all")


class CubeError(ValueError):
    """A navigation step that the view doesn't allow."""


def typed(level: str, value: object) -> object:
    kind = LEVELS[level].kind
    return dt.date.fromisoformat(str(value)) if kind == "date" else int(str(value))


def _month(value: int) -> tuple[dt.date, dt.date]:
    """First and last day of a month yyyymm."""
    first = dt.date(value // 100, value % 100, 1)
    return first, (first + dt.timedelta(days=31)).replace(day=1) - dt.timedelta(days=1)


def _carried(old: str, new: str, bounds: tuple, regions: Mapping[int, int] | None) -> tuple | None:
    """A range of one level on the next coarser or finer one of its dimension; None if it has no such meaning there.

    A coarser range covers all that the finer one does. Nations and regions need `regions`,
    each nation's region; a region whose nations are no range of numbers has no range of nations.
    """
    lo, hi = bounds
    match old, new:
        case "o_date", "o_yearmonth":
            return lo.year * 100 + lo.month, hi.year * 100 + hi.month
        case "o_yearmonth", "o_year":
            return lo // 100, hi // 100
        case "o_year", "o_yearmonth":
            return lo * 100 + 1, hi * 100 + 12
        case "o_yearmonth", "o_date":
            return _month(lo)[0], _month(hi)[1]
        case ("c_nation_id", "c_region_id") if regions:
            found = [r for n, r in regions.items() if lo <= n <= hi]
            return (min(found), max(found)) if found else None
        case ("c_region_id", "c_nation_id") if regions:
            found = sorted(n for n, r in regions.items() if lo <= r <= hi)
            whole = found and found == [n for n in sorted(regions) if found[0] <= n <= found[-1]]
            return (found[0], found[-1]) if whole else None
    return None


@dataclass(frozen=True)
class CubeView:
    """One level for some dimensions and inclusive ranges on those levels. Steps return new views."""

    levels: Mapping[str, str] = field(default_factory=dict)
    ranges: Mapping[str, tuple] = field(default_factory=dict)

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(sorted(self.levels.values()))

    def _moved(self, dim: str, level: str | None, carry: bool, regions: Mapping[int, int] | None) -> CubeView:
        levels = {d: x for d, x in self.levels.items() if d != dim} | ({dim: level} if level else {})
        ranges = {d: r for d, r in self.ranges.items() if d != dim}
        if carry and level and dim in self.ranges and (kept := _carried(self.levels[dim], level, self.ranges[dim], regions)):
            ranges[dim] = kept
        return CubeView(levels, ranges)

    def drill_down(self, dim: str, carry_selection: bool = False, regions: Mapping[int, int] | None = None) -> CubeView:
        """One level finer; the dimension's range is dropped unless carried."""
        d = _dimension(dim)
        at = d.index(self.levels[dim]) + 1 if dim in self.levels else 0
        if at == len(d.levels):
            raise CubeError(f"{dim} is at its finest level")
        return self._moved(dim, d.levels[at].name, carry_selection, regions)

    def roll_up(self, dim: str, carry_selection: bool = False, regions: Mapping[int, int] | None = None) -> CubeView:
        """One level coarser; from the coarsest the dimension goes. Its range is dropped unless carried."""
        d = _dimension(dim)
        if dim not in self.levels:
            raise CubeError(f"{dim} is not in the view")
        at = d.index(self.levels[dim]) - 1
        return self._moved(dim, d.levels[at].name if at >= 0 else None, carry_selection, regions)

    def slice(self, dim: str, value: object) -> CubeView:
        return self.dice({dim: (value, value)})

    def dice(self, ranges: Mapping[str, tuple]) -> CubeView:
        """All ranges at once; each must lie within the range there is."""
        new = dict(self.ranges)
        for dim, (lo, hi) in ranges.items():
            _dimension(dim)
            if dim not in self.levels:
                raise CubeError(f"{dim} is not in the view")
            lo, hi = typed(self.levels[dim], lo), typed(self.levels[dim], hi)
            if dim in self.ranges and not (self.ranges[dim][0] <= lo and hi <= self.ranges[dim][1]):
                raise CubeError(f"{dim} is already limited to {self.ranges[dim]}")
            new[dim] = (lo, hi)
        return replace(self, ranges=new)


def _dimension(name: str) -> Dimension:
    if name not in BY_NAME:
        raise CubeError(f"no such dimension: {name}")
    return BY_NAME[name]


@dataclass
class History:
    """The view at hand and those before it."""

    view: CubeView = field(default_factory=CubeView)
    past: list[CubeView] = field(default_factory=list)

    def go(self, view: CubeView) -> CubeView:
        self.past.append(self.view)
        self.view = view
        return view

    def undo(self) -> CubeView:
        if not self.past:
            raise CubeError("nothing to undo")
        self.view = self.past.pop()
        return self.view
