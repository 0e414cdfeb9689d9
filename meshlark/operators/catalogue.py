"""Layout and dataset catalogues: resolution, merging, availability, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.operators.graph import clean_name


def resolve(catalogue: DataFrame, name: str) -> DataFrame:
    """The row of a full id or unique short name; otherwise an error with the candidates or the five nearest names."""
    if not isinstance(name, str):
        raise TypeError("a dataset name is one string")
    hit = catalogue.where((F.col("id") == name) | (F.col("name") == name))
    found = [r.id for r in hit.select("id").limit(20).collect()]
    if name in found:
        return hit.where(F.col("id") == name)
    if len(found) > 1:
        raise ValueError(f"{name!r} is ambiguous: {sorted(found)}")
    if not found:
        raise ValueError(f"no dataset {name!r}; nearest: {[r.name for r in suggest(catalogue, name).collect()]}")
    return hit


def suggest(catalogue: DataFrame, name: str, k: int = 5) -> DataFrame:
    return catalogue.select("name", F.levenshtein("name", F.lit(name)).alias("distance")).orderBy("distance", "name").limit(k)


def layout_id(stage, candidate, seed):
    return clean_name(F.concat(stage, F.lit("__"), candidate, F.lit("__seed_"), F.format_string("%03d", seed)))


def normalise_columns(df: DataFrame) -> DataFrame:
    import re

    return df.toDF(*(re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", c.lower())) for c in df.columns))


def from_runs(runs: DataFrame, stage: str = "compare") -> DataFrame:
    """Runs as catalogue rows with ids and defaults."""
    return runs.select(layout_id(F.lit(stage), F.col("candidate"), F.col("seed")).alias("layout_id"), "candidate", F.lit(stage).alias("stage"), F.col("seed").cast("int").alias("seed"), F.coalesce("status", F.lit("ok")).alias("status"))


def availability(layouts: DataFrame) -> DataFrame:
    """availability: interactive with coordinates, artifact-only with a rendered file, else summary-only; viewable unless the last."""
    has = lambda c: (F.coalesce(F.col(c), F.lit("")) != "") if c in layouts.columns else F.lit(False)
    a = F.when(has("coords_path"), "interactive").when(has("html_path") | has("gif_path") | has("thumbnail_path"), "artifact-only").otherwise("summary-only")
    return layouts.withColumn("availability", a).withColumn("viewable", F.col("availability") != "summary-only")


def first_nonempty(df: DataFrame, columns: list[str]) -> str | None:
    """The first column that has any non-empty value."""
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return None
    got = df.agg(*(F.max(F.coalesce(F.col(c), F.lit("")) != "").alias(c) for c in columns)).first()
    return next((c for c in columns if got[c]), None)


def attach_manifest(layouts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Left join by candidate and seed; manifest columns fill what the layout lacks."""
    m = manifest.select("candidate", "seed", *(F.col(c).alias(f"_m_{c}") for c in manifest.columns if c not in ("candidate", "seed")))
    j = layouts.join(m, ["candidate", "seed"], "left")
    for c in manifest.columns:
        if c not in ("candidate", "seed"):
            j = j.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_m_{c}")) if c in layouts.columns else F.col(f"_m_{c}"))
    return j.drop(*(f"_m_{c}" for c in manifest.columns))


def bind_fill(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def validate(layouts: DataFrame, graphs: DataFrame | None = None) -> None:
    if not layouts.groupBy("layout_id").count().where("count > 1").isEmpty():
        raise ValueError("layout ids repeat")
    if graphs is not None and "graph_id" in layouts.columns:
        lost = layouts.where("graph_id is not null").join(graphs.select("graph_id"), "graph_id", "left_anti")
        if not lost.isEmpty():
            raise ValueError("a layout names an unknown graph")


def best_key(vertices: DataFrame, ids: DataFrame, columns: list[str]) -> str:
    """The column of ``vertices`` with most matches among ``ids`` (id)."""
    i = ids.select(F.col("id").cast("string").alias("id")).distinct()
    counts = {c: vertices.select(F.col(c).cast("string").alias("id")).join(i, "id", "left_semi").count() for c in columns}
    return max(columns, key=lambda c: (counts[c], -columns.index(c)))


def align_embedding(vertices: DataFrame, embedding: DataFrame, key: str, id_column: str = "vertex_id") -> DataFrame:
    """Coordinates in vertex order: unmatched vertices have null coordinates."""
    xyz = [c for c in embedding.columns if c != id_column]
    e = embedding.select(F.col(id_column).cast("string").alias("_id"), *xyz)
    return vertices.select("v", F.col(key).cast("string").alias("_id")).join(e, "_id", "left").select("v", *xyz)


GRAPH_CATALOGUE = "id string, name string, family string, n_vertices bigint, n_edges bigint, n_components bigint"


def graph_row(spark: SparkSession, id_: str, family: str, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row of a catalogue of graphs; the short name is what follows the last slash of the id."""
    from meshlark.operators.components import numbered

    n = vertices.agg(F.count(F.lit(1)).alias("n_vertices"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    c = numbered(vertices, edges).agg(F.max("component").cast("bigint").alias("n_components"))
    return n.crossJoin(e).crossJoin(c).select(F.lit(id_).alias("id"), F.lit(id_.rpartition("/")[2]).alias("name"), F.lit(family).alias("family"), "n_vertices", "n_edges", "n_components")  # one row each


def check_catalogue(catalogue: DataFrame) -> DataFrame:
    if not catalogue.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        raise ValueError("graph ids repeat or are missing")
    return catalogue


def attach_layouts(catalogue: DataFrame, layouts: DataFrame) -> DataFrame:
    """Catalogue rows with the coordinates of their (candidate, seed), if ``layouts`` (candidate, seed, v, x) has any: ``n_coords`` rows of them, and the availability that follows."""
    n = layouts.groupBy("candidate", "seed").agg(F.count(F.lit(1)).alias("n_coords"))
    j = catalogue.join(n, ["candidate", "seed"], "left")
    own = F.col("coords_path") if "coords_path" in catalogue.columns else F.lit(None).cast("string")
    return availability(j.withColumn("n_coords", F.coalesce("n_coords", F.lit(0).cast("bigint"))).withColumn("coords_path", F.coalesce(own, F.when(F.col("n_coords") > 0, F.lit("memory")))))


def layout_coordinates(result) -> DataFrame:
    """The coordinates (v, x) of a table, a fit, or a pair of (coords, rest); finite and of two dimensions at least."""
    found = result if isinstance(result, DataFrame) else getattr(result, "coords", None)
    if not isinstance(found, DataFrame) or not {"v", "x"} <= set(found.columns):
        raise ValueError("no coordinates (v, x) here")
    bad = found.where(F.col("x").isNull() | (F.size("x") < 2) | F.exists("x", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == F.lit(float("inf")))))
    if not bad.isEmpty():
        raise ValueError("coordinates are finite and have two dimensions at least")
    if found.groupBy("v").count().where("count > 1").limit(1).count():
        raise ValueError("a vertex has two rows of coordinates")
    return found.select("v", "x")
