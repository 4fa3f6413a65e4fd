"""The cube's command language: drilldown, rollup, slice, dice, limit, dump, undo, exit."""

from __future__ import annotations

import datetime as dt
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import report
from .engine import query
from .model import DIMENSIONS, CubeError, History

HELP = "drilldown <dim> | rollup <dim> | slice <dim> <value> | dice <dim> <lo> <hi> | limit <n> | dump <file> [<n>] | undo | exit"
SHOWN, DUMPED = 20, 1000


@dataclass
class Shell:
    spark: SparkSession
    sf_dir: str
    path: str | None = None
    history: History = field(default_factory=History)
    limit: int = SHOWN
    over: bool = False

    def rows(self, limit: int | None = None) -> DataFrame:
        return query(self.spark, self.sf_dir, self.history.view, self.path, self.limit if limit is None else limit)

    def step(self, line: str) -> bool:
        """Run a command of navigation; False if it is none. The view's refusals are errors."""
        match line.split():
            case ["drilldown", dim]:
                self.history.go(self.history.view.drill_down(dim))
            case ["rollup", dim]:
                self.history.go(self.history.view.roll_up(dim))
            case ["slice", dim, value]:
                self.history.go(self.history.view.slice(dim, value))
            case ["dice", dim, lo, hi]:
                self.history.go(self.history.view.dice({dim: (lo, hi)}))
            case ["undo"]:
                self.history.undo()
            case _:
                return False
        return True

    def execute(self, line: str) -> str:
        """Run one command and give its output; refusals and mistakes are output too."""
        try:
            if not self.step(line):
                match line.split():
                    case ["limit", n]:
                        self.limit = int(n)
                    case ["dump", file, *n]:
                        with open(file, "w") as f:
                            f.write(report(self.rows(0), int(n[0]) if n else DUMPED) + "\n")
                        return f"written to {file}"
                    case ["exit" | "quit"]:
                        self.over = True
                        return ""
                    case _:
                        return HELP
        except (CubeError, ValueError) as problem:
            return f"refused: {problem}"
        return report(self.rows(), 0)

    def loop(self) -> None:
        print(report(self.rows(), 0))
        while not self.over:
            try:
                print(self.execute(input("> ")))
            except EOFError:
                return


def _range(rng: random.Random, level: str) -> tuple[str, str]:
    """Two values of a level in order, from its usual domain."""
    if level == "o_date":
        days = sorted(rng.randrange(2500) for _ in range(2))
        return tuple(str(dt.date(1995, 1, 1) + dt.timedelta(days=d)) for d in days)
    if level == "o_yearmonth":
        return tuple(str(x) for x in sorted(rng.randint(1995, 2001) * 100 + rng.randint(1, 12) for _ in range(2)))
    low, high = {"o_year": (1995, 2001), "c_region_id": (0, 4), "c_nation_id": (0, 24)}.get(level, (0, 1000))
    return tuple(str(x) for x in sorted(rng.randint(low, high) for _ in range(2)))


def random_walk(steps: int, seed: int = 0) -> list[str]:
    """Commands of a random navigation, none of which the view refuses."""
    rng, out, h = random.Random(seed), [], History()
    while len(out) < steps:
        dim, kind = rng.choice(DIMENSIONS).name, rng.choice(("drilldown", "drilldown", "rollup", "slice", "dice"))
        try:
            if kind == "drilldown":
                h.go(h.view.drill_down(dim))
                out.append(f"drilldown {dim}")
            elif kind == "rollup":
                h.go(h.view.roll_up(dim))
                out.append(f"rollup {dim}")
            elif dim in h.view.levels:
                lo, hi = _range(rng, h.view.levels[dim])
                h.go(h.view.dice({dim: (lo, hi)}) if kind == "dice" else h.view.slice(dim, lo))
                out.append(f"dice {dim} {lo} {hi}" if kind == "dice" else f"slice {dim} {lo}")
        except CubeError:
            continue
    return out
