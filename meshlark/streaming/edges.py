"""An extension: degrees of a stream of edge batches; the state is the stream's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degree_stream(edges: DataFrame) -> DataFrame:
    """Running degree of each vertex of a streaming (or static) edge table; write it in complete or update mode."""
    return edges.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))
