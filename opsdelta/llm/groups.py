"""Connected components of an undirected graph, in rounds of joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_and_count
from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); the root is the least node that it is connected with.

    A round adopts the least label of the neighbours and of the node that the own
    label names, so the distance that labels cover doubles. Each round is one join and
    one aggregate, whose rows combine before the shuffle; the driver reads a count.
    """
    edges = staged(edges.select("a", "b").distinct(), "edges")
    along = edges.select(F.col("a").alias("asks"), F.col("b").alias("whom")).unionByName(edges.select(F.col("b").alias("asks"), F.col("a").alias("whom")))
    labels = along.groupBy(F.col("asks").alias("node")).agg(F.min(F.least("asks", "whom")).alias("root"))
    labels, left = cut_and_count(labels)
    while left:
        questions = along.unionByName(labels.select(F.col("node").alias("asks"), F.col("root").alias("whom")))
        answers = questions.join(labels.select(F.col("node").alias("whom"), "root"), "whom").select(F.col("asks").alias("node"), "root", F.lit(None).cast(labels.schema["root"].dataType).alias("was"))
        labels, left = cut_and_count(
            labels.withColumn("was", F.col("root")).unionByName(answers).groupBy("node").agg(F.min("root").alias("root"), F.min("was").alias("was")),
            F.col("root") != F.col("was"),
        )
        labels = labels.select("node", "root")
    return labels
