"""``python -m linkloom.add_seeds STORE FILE [STRATEGY]``: schedule the URLs of a file, one a line, in a store."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from linkloom.operators import order
from linkloom.plans import strategies
from linkloom.plans.session import FrontierSession
from linkloom.plans.settings import Settings
from linkloom.sources import seeds

STRATEGIES = {"basic": strategies.Basic, "breadth_first": strategies.BreadthFirst, "depth_first": strategies.DepthFirst, "discovery": strategies.Discovery}


def add(spark: SparkSession, store: str, path: str, strategy: str = "basic", settings: Settings = Settings()) -> None:
    """Schedule the lines of ``path`` (any path that Spark reads)."""
    if strategy == "discovery":
        chosen = strategies.Discovery(settings.discovery_max_pages, settings.user_agent)
    else:
        chosen = STRATEGIES[strategy]()
    with FrontierSession(spark, store, chosen, settings) as frontier:
        frontier.add_seeds(order.numbered(seeds.read(spark, path).distinct(), "url", name="seq"))


def main(args: list[str]) -> int:
    if len(args) not in (2, 3) or args[2:] and args[2] not in STRATEGIES:
        print(__doc__, file=sys.stderr)
        return 2
    add(SparkSession.builder.appName("add_seeds").getOrCreate(), *args)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
