"""Graphs as tables: edges (src, dst, w), vertices (v). Validation, canonical form, subgraphs, packing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.functions import vectors as V
from meshlark.operators.components import numbered


def with_lengths(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", (F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)).alias("w"))


def canonical(edges: DataFrame) -> DataFrame:
    """One row per undirected edge, smaller end first, without loops; parallel edges leave the shortest."""
    return with_lengths(edges).where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("w").alias("w"))


def duplicates(edges: DataFrame) -> DataFrame:
    """Undirected edges that occur more than once."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).count().where("count > 1")


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    e = with_lengths(edges)
    return e.union(e.select("dst", "src", "w"))


def adjacency_lists(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("u"), "w"))).alias("nbrs"))


def from_adjacency(adj: DataFrame) -> DataFrame:
    """Edges of reciprocal adjacency lists."""
    check_reciprocal(adj)
    return adj.select(F.col("v").alias("src"), F.explode("nbrs").alias("x")).select("src", F.col("x.u").alias("dst"), F.col("x.w").alias("w")).where("src < dst")


def check_reciprocal(adj: DataFrame) -> None:
    d = adj.select(F.col("v").alias("src"), F.explode("nbrs").alias("x")).select("src", F.col("x.u").alias("dst"), F.col("x.w").alias("w"))
    if not d.where("src = dst").isEmpty():
        raise ValueError("self-loops are not allowed")
    if not d.select("src", "dst").exceptAll(d.select("dst", "src")).isEmpty():
        raise ValueError("adjacency lists are not reciprocal")
    if not d.exceptAll(d.select("dst", "src", "w")).isEmpty():
        raise ValueError("reciprocal entries have different lengths")


def check_ids(df: DataFrame, columns: list[str], upper: int | None = None) -> None:
    """Ids are finite whole numbers from 1 to ``upper``; the error names the first that is not."""
    for c in columns:
        v = F.col(c).cast("double")
        bad = v.isNull() | F.isnan(v) | (v < 1) | (v != F.floor(v)) | (F.lit(False) if upper is None else v > upper) | (F.abs(v) == F.lit(float("inf")))
        if row := df.where(bad).select(c).first():
            raise ValueError(f"{c}: {row[0]!r} is not a vertex id from 1 to {upper or 'n'}")


@dataclass
class Graph:
    """Exactly one of ``edges`` or ``adj``; ``n`` keeps isolated vertices."""

    edges: DataFrame
    vertices: DataFrame

    @classmethod
    def build(cls, edges: DataFrame | None = None, adj: DataFrame | None = None, n: int | None = None, vertices: DataFrame | None = None) -> Graph:
        if (edges is None) == (adj is None):
            raise ValueError("give either edges or adj")
        if n is not None and (isinstance(n, bool) or int(n) != n or n < 1):
            raise ValueError("n must be a whole number from 1")
        if adj is not None:
            edges, vertices = from_adjacency(adj), adj.select("v") if vertices is None else vertices
        check_ids(edges, ["src", "dst"], n)
        e = with_lengths(edges)
        if not e.where("src = dst").isEmpty():
            raise ValueError("self-loops are not allowed")
        if not e.where("w is null or isnan(w) or w <= 0 or w = double('Infinity')").isEmpty():
            raise ValueError("edge lengths must be finite and above 0")
        if vertices is None:
            n = n or int(e.agg(F.max(F.greatest("src", "dst"))).first()[0] or 0)
            vertices = e.sparkSession.range(1, n + 1).withColumnRenamed("id", "v")
        return cls(e, vertices)

    def degrees(self) -> DataFrame:
        d = adjacency(self.edges).groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.select("v").join(d, "v", "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree"))

    def components(self) -> DataFrame:
        return numbered(self.vertices, self.edges)

    def induced(self, keep: DataFrame) -> Graph:
        """The subgraph on ``keep`` (v), relabelled from 1 in id order."""
        k = keep.select("v", F.row_number().over(Window.orderBy("v")).cast("bigint").alias("new"))
        e = self.edges.join(k.select(F.col("v").alias("src"), F.col("new").alias("s")), "src").join(k.select(F.col("v").alias("dst"), F.col("new").alias("d")), "dst")
        return Graph(e.select(F.col("s").alias("src"), F.col("d").alias("dst"), "w"), k.select(F.col("new").alias("v")))

    def active(self, keep: DataFrame) -> DataFrame:
        """Edges with both ends in ``keep``."""
        return self.edges.join(keep.select(F.col("v").alias("src")), "src", "left_semi").join(keep.select(F.col("v").alias("dst")), "dst", "left_semi").select("src", "dst", "w")


def normalize_lengths(edges: DataFrame, by: str = "median") -> DataFrame:
    """Lengths divided by their median or mean."""
    if by == "none":
        return edges
    scale = edges.agg((F.percentile("w", F.lit(0.5)) if by == "median" else F.avg("w")).alias("_s"))
    return edges.crossJoin(F.broadcast(scale)).select("src", "dst", (F.col("w") / F.col("_s")).alias("w"))  # one row


def edge_lengths(edges: DataFrame, coords: DataFrame, distance=V.euclid) -> DataFrame:
    """edges with ``len``, the distance of the ends' coordinates."""
    a, b = (coords.select(F.col("v").alias(c), F.col("x").alias(f"_{c}")) for c in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").withColumn("len", distance("_src", "_dst")).drop("_src", "_dst")


def lengths_from_coords(edges: DataFrame, coords: DataFrame, by: str = "median") -> DataFrame:
    e = edge_lengths(edges.select("src", "dst"), coords).select("src", "dst", F.col("len").alias("w"))
    if not e.where("w <= 0").isEmpty():
        raise ValueError("an edge has no length")
    return normalize_lengths(e, by)


def pack_components(coords: DataFrame, components: DataFrame) -> DataFrame:
    """Component layouts side by side: each centred; larger ones first; the gap is 1.5 median radii."""
    dims = len(coords.first()["x"])
    c = coords.join(components, "v")
    centre = c.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.array(*(F.avg(F.get("x", F.lit(k))) for k in range(dims))).alias("m"))
    c = c.join(centre, "component").withColumn("x", V.minus("x", "m"))
    r = c.groupBy("component", "size").agg(F.max(V.norm("x")).alias("r")).withColumn("r", F.when(F.col("r") > 0, F.col("r")).otherwise(F.lit(1.0)))
    w = Window.orderBy(F.desc("size"), "component")
    gap = 1.5 * F.percentile("r", F.lit(0.5)).over(Window.partitionBy())
    step = F.coalesce(F.lag("r").over(w), F.lit(0.0)) + F.col("r") + gap
    r = r.withColumn("gap", gap).withColumn("step", F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(step)).withColumn("shift", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.join(r.select("component", "shift"), "component").select("v", F.transform("x", lambda a, i: F.when(i == 0, a + F.col("shift")).otherwise(a)).alias("x"))


def clean_name(c: Column) -> Column:
    """Lower case, other characters than letters and digits as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
