"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import stage


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node in ``links`` (columns ``a, b``); the root is the smallest node of the component.

    In each round every node moves to its smallest neighbour, and the links are redrawn between the new places; links
    within one place go. Connectivity is kept, the smallest node of a component never moves, and when no link is left
    every component is at one place. Only partial minima and joins are used, so a node with very many links is no
    single task's work; each round is written to the shared folder.
    """
    links = stage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "links",
    )
    places = stage(
        links.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("root", F.col("node")), "places"
    )
    while not links.isEmpty():
        moves = stage(links.groupBy(F.col("hi").alias("_from")).agg(F.min("lo").alias("_to")), "moves")
        places = stage(
            places.join(moves, places.root == moves._from, "left")
            .select("node", F.coalesce("_to", "root").alias("root")),
            "places",
        )
        upper = links.join(moves, links.hi == moves._from).select(F.col("_to").alias("hi"), "lo")
        both = upper.join(moves, upper.lo == moves._from, "left").select("hi", F.coalesce("_to", "lo").alias("lo"))
        links = stage(
            both.filter("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(),
            "links",
        )
    return places
