"""Random parameter values, the generator's rules restated for this data; and query streams."""

from __future__ import annotations

import datetime as dt
import random

from .catalogue import QUERIES

#: Domains of the generated columns.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
TYPES = ("PROMO", "ECONOMY", "MEDIUM", "SMALL", "STANDARD", "LARGE")
MODES = ("REG AIR", "AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB")
NAME_WORDS = ("small", "large", "red", "blue", "hot", "cold", "old", "new")
COMMENT_WORDS = (("special", "pending", "unusual", "express"), ("packages", "requests", "accounts", "deposits"))


def draw(name: str, seed: int) -> dict[str, object]:
    """Parameters of a query for a seed; those without a rule keep their defaults."""
    rng = random.Random(f"{name}/{seed}")
    base = name.rstrip("a")
    out = dict(QUERIES[name].params)
    nations = [f"NATION_{i}" for i in rng.sample(range(25), 2)]
    month = dt.date(rng.randint(1995, 1999), rng.randint(1, 12), 1)
    january = dt.date(rng.randint(1995, 1999), 1, 1)
    rules: dict[str, dict[str, object]] = {
        "q1": {"delta": rng.randint(60, 120)},
        "q2": {"size": rng.randint(1, 50), "type": rng.choice(TYPES), "region": rng.choice(REGIONS)},
        "q3": {"segment": rng.choice(SEGMENTS), "day": dt.date(1997, 3, rng.randint(1, 31))},
        "q4": {"start": month},
        "q5": {"region": rng.choice(REGIONS), "start": january},
        "q6": {"start": january, "discount": f"0.0{rng.randint(2, 9)}", "quantity": rng.randint(24, 25)},
        "q7": {"one": nations[0], "two": nations[1]},
        "q8": {"nation": nations[0], "region": REGIONS[int(nations[0][7:]) % 5], "type": rng.choice(TYPES)},
        "q9": {"word": rng.choice(NAME_WORDS)},
        "q10": {"start": month},
        "q11": {"nation": nations[0]},
        "q12": dict(zip(("mode1", "mode2"), rng.sample(MODES, 2), strict=True)) | {"start": january},
        "q13": {"word1": rng.choice(COMMENT_WORDS[0]), "word2": rng.choice(COMMENT_WORDS[1])},
        "q14": {"start": month},
        "q15": {"start": month},
        "q16": {"brand": f"Brand#{rng.randint(1, 25)}", "type": rng.choice(TYPES)} | {f"s{i}": size for i, size in enumerate(rng.sample(range(1, 51), 8), 1)},
        "q17": {"brand": f"Brand#{rng.randint(1, 25)}"},
        "q18": {"quantity": rng.randint(240, 315)},
        "q19": {"q1": rng.randint(1, 10), "q2": rng.randint(10, 20), "q3": rng.randint(20, 30)} | {f"brand{i}": f"Brand#{rng.randint(1, 25)}" for i in (1, 2, 3)},
        "q20": {"word": rng.choice(NAME_WORDS), "nation": nations[0], "start": january},
        "q21": {"nation": nations[0]},
        "q22": {f"c{i}": str(c) for i, c in enumerate(rng.sample(range(10, 35), 7), 1)},
    }
    return out | rules.get(base, {})


def read_streams(path: str) -> list[list[str]]:
    """Query orders from a text file, one permutation of 1 to 22 a line, as the generator's kit lists them."""
    with open(path) as f:
        orders = [[int(x) for x in line.replace(",", " ").split()] for line in f if line.strip()]
    for order in orders:
        if sorted(order) != list(range(1, 23)):
            raise ValueError(f"not a permutation of 1 to 22: {order}")
    return [[f"q{i}" for i in order] for order in orders]


def stream(number: int, orders: list[list[str]] | None = None) -> list[str]:
    """The order of the 22 queries in a stream.

    With `orders` (see `read_streams`) streams go round in them. Without, stream 0 is
    1 to 22 and each other one a permutation drawn by its number.
    """
    if orders:
        return orders[number % len(orders)]
    order = [f"q{i}" for i in range(1, 23)]
    if number:
        random.Random(number).shuffle(order)
    return order
