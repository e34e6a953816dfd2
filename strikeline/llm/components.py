"""Connected components by contraction, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.llm.common import SMALL_ROWS
from strikeline.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """node, label of every node in ``links`` (a, b): the smallest node it is connected to.

    In each round every node points to its smallest neighbour. Two nodes that point to each
    other end a path; the smaller of them is then the smallest of all that lead there. Pointers
    are doubled until all show such an end, and the links between ends are what is left. Each
    end stands for two nodes at least, so rounds, and doublings in a round, grow with the
    logarithm of the nodes at most, whatever the order of ids. Every step is written to the
    shared folder. Pointers are broadcast while they are counted to be few.
    """
    links = cut_lineage(links.where("a <> b").select("a", "b").distinct())
    labels = cut_lineage(
        links.select(F.col("a").alias("node")).unionAll(links.select("b")).distinct()
        .withColumn("label", F.col("node"))
    )
    while not links.isEmpty():
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = cut_lineage(
            both.groupBy("a").agg(F.min("b").alias("b"))
            .select(F.col("a").alias("node"), F.col("b").alias("next"))
        )
        few = nearest.count() <= SMALL_ROWS

        def to(column: str, pointers: DataFrame, few: bool = few) -> DataFrame:
            pointers = pointers.select(
                F.col("node").alias(column), F.col("next").alias(f"{column}_next")
            )
            return F.broadcast(pointers) if few else pointers

        end = (F.col("next_next") == F.col("node")) & (F.col("node") < F.col("next"))
        nearest = cut_lineage(
            nearest.join(to("next", nearest), "next")
            .select("node", F.when(end, F.col("node")).otherwise(F.col("next")).alias("next"))
        )
        moved = True
        while moved:
            doubled = cut_lineage(
                nearest.join(to("next", nearest), "next")
                .select("node", F.col("next_next").alias("next"),
                        (F.col("next") != F.col("next_next")).alias("moved"))
            )
            moved = not doubled.where("moved").isEmpty()
            nearest = doubled.select("node", "next")

        links = cut_lineage(
            links.join(to("a", nearest), "a").join(to("b", nearest), "b")
            .where("a_next <> b_next")
            .select(F.least("a_next", "b_next").alias("a"), F.greatest("a_next", "b_next").alias("b"))
            .distinct()
        )
        labels = cut_lineage(
            labels.join(to("label", nearest), "label", "left")
            .select("node", F.coalesce("label_next", "label").alias("label"))
        )
    return labels
