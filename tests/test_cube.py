import datetime as dt

import pytest

from cubelark.cube import engine
from cubelark.cube.model import CubeError, CubeView, History, cuboid_name, cuboids, is_stored
from cubelark.cube.shell import Shell, random_walk

SF = "/root/testdata/sf0.001"


def test_twenty_four_cuboids_eighteen_stored():
    assert len(cuboids()) == 24
    assert sum(map(is_stored, cuboids())) == 18
    assert cuboid_name(("product_id", "o_date")) == "cube_results_V__o_date__product_id"


def test_navigation():
    h = History()
    h.go(h.view.drill_down("time"))
    h.go(h.view.dice({"time": ("1995", "1997")}))
    with pytest.raises(CubeError):
        h.view.slice("time", 1999)
    with pytest.raises(CubeError):
        h.view.slice("product", 1)
    deeper = h.go(h.view.drill_down("time"))
    assert deeper.ranges == {} and deeper.columns == ("o_yearmonth",)
    assert deeper.roll_up("time").levels == {"time": "o_year"}
    assert deeper.roll_up("time").roll_up("time") == CubeView()
    assert h.undo().ranges == {"time": (1995, 1997)}
    day = CubeView({"time": "o_date"}, {"time": (dt.date(1996, 2, 1), dt.date(1996, 3, 1))})
    assert day.roll_up("time", carry_selection=True).ranges == {"time": (199602, 199603)}
    with pytest.raises(CubeError):
        day.drill_down("time")


def test_ranges_are_carried_up_and_down():
    regions = {n: n % 5 for n in range(25)}
    month = CubeView({"time": "o_yearmonth"}, {"time": (199511, 199602)})
    assert month.roll_up("time", True).ranges == {"time": (1995, 1996)}
    assert month.drill_down("time", True).ranges == {"time": (dt.date(1995, 11, 1), dt.date(1996, 2, 29))}
    assert month.roll_up("time", True).drill_down("time", True).ranges == {"time": (199501, 199612)}
    nation = CubeView({"customer_location": "c_nation_id"}, {"customer_location": (7, 8)})
    assert nation.roll_up("customer_location", True, regions).ranges == {"customer_location": (2, 3)}
    assert nation.roll_up("customer_location", True).ranges == {} and nation.roll_up("customer_location").ranges == {}
    region = CubeView({"customer_location": "c_region_id"}, {"customer_location": (1, 1)})
    assert region.drill_down("customer_location", True, regions).ranges == {}  # 1, 6, 11, ... is no range
    assert region.drill_down("customer_location", True, {3: 1, 4: 1, 5: 2}).ranges == {"customer_location": (3, 4)}


def test_random_walks_run_and_use_every_step():
    used = set()
    for seed in range(20):
        shell = Shell(None, "")
        for command in random_walk(15, seed):
            assert shell.step(command)
            used.add(command.split()[0])
    assert used == {"drilldown", "rollup", "slice", "dice"}


def test_stored_and_virtual_routes_agree_and_sums_hold(spark, tmp_path):
    path = str(tmp_path / "cube")
    engine.build(spark, SF, path)
    facts = engine.facts(spark, SF)
    total = engine.aggregate(facts, ()).first()
    import pyspark.sql.functions as F

    sums = spark.read.parquet(path).groupBy("cuboid").agg(F.sum("sum_volume").alias("s"), F.sum("count_volume").alias("c")).collect()
    assert len(sums) == 18
    assert all(r["s"] == total["sum_volume"] and r["c"] == total["count_volume"] for r in sums)
    view = CubeView({"time": "o_year", "customer_location": "c_region_id"}, {"time": (1996, 1997)})
    stored, made = (engine.query(spark, SF, view, p).collect() for p in (path, None))
    assert stored == made and len(stored) > 0


def test_shell(spark, tmp_path):
    shell = Shell(spark, SF)
    assert "refused" in shell.execute("rollup time")
    assert shell.execute("drilldown time").splitlines()[0] == "o_year|sum_volume|count_volume"
    assert len(shell.execute("dice time 1996 1997").splitlines()) == 3
    shell.execute("limit 1")
    assert len(shell.rows().collect()) == 1
    shell.execute(f"dump {tmp_path / 'out.txt'} 5")
    assert (tmp_path / "out.txt").read_text().startswith("o_year|")
    assert "drilldown" in shell.execute("help")
    shell.execute("undo")
    assert shell.history.view.ranges == {}
    shell.execute("quit")
    assert shell.over
    assert len(random_walk(12, 3)) == 12


@pytest.mark.parametrize("name", ["cube_averages_stored", "cube_merge_delta_stored"])
def test_stored_cuboids_match_sql(spark, name):
    from test_queries import TABLES, duckdb, plain

    from cubelark import registry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    query, sql = registry.MADE[name]
    df = query(spark, SF)
    result = con.execute(sql)
    at = [[d[0] for d in result.description].index(c) for c in df.columns]
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert {r[df.columns.index("cuboid")] for r in got} == {"__".join(c) or "all" for c in cuboids() if is_stored(c)}
