"""python -m cubelark COMMAND

q7 DIR NATION NATION | q8 DIR NATION REGION TYPE | build DIR CUBE | browser DIR [CUBE] | operations DIR N [SEED] | parameter-set | validator DIR TARGET | generate SCALE TARGET
"""

from __future__ import annotations

import sys
import time

from .cube.engine import build
from .cube.model import cuboid_name, cuboids
from .cube.shell import Shell, random_walk
from .plans.shipping import q7, q8
from .session import session
from .sources.generator import generated
from .sources.sinks import dump_all, report


def main(args: list[str]) -> int:
    spark, began = session(), time.time()
    match args:
        case ["q7", sf_dir, one, two]:
            print(report(q7(spark, sf_dir, one.upper(), two.upper()), 0))
        case ["q8", sf_dir, nation, region, kind]:
            print(report(q8(spark, sf_dir, nation.upper(), region.upper(), kind.upper()), 0))
        case ["build", sf_dir, path]:
            build(spark, sf_dir, path)
        case ["browser", sf_dir, *path]:
            Shell(spark, sf_dir, *path).loop()
        case ["operations" | "walk", sf_dir, steps, *seed]:
            shell = Shell(spark, sf_dir)
            for command in random_walk(int(steps), *map(int, seed)):
                print(f"> {command}\n{shell.execute(command)}")
        case ["parameter-set"]:
            for levels in cuboids():
                print(cuboid_name(levels))
        case ["validator", sf_dir, target]:
            dump_all(spark, sf_dir, target)
        case ["generate", scale, target]:
            for name, df in generated(spark, float(scale)).items():
                df.write.mode("overwrite").parquet(f"{target}/{name}.parquet")
        case _:
            print(__doc__)
            return 2
    print(f"{time.time() - began:.2f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
