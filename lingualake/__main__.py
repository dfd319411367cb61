"""python -m lingualake [folder]: run the project of a folder by its one configuration file."""

from __future__ import annotations

import sys

from . import config, session
from .plans import project
from .sources import entities


def main(folder: str = ".") -> list[str]:
    c = config.load(config.discover(folder))
    for k in c.unknown:
        print(f"not used: {k}", file=sys.stderr)
    spark = session.build()
    for v in entities.check_layout(spark, folder).collect():
        print(f"{v['severity']}: {v['rule']}", file=sys.stderr)
    return project.write(project.run(spark, folder, c), f"{folder}/derivatives")


if __name__ == "__main__":
    main(*sys.argv[1:2])
