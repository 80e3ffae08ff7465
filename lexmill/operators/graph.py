"""The citation graph: merged edges, weighted PageRank, authority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import materialise

# Fixed values of the ranking model.
DAMPING, TOLERANCE, ITERATIONS = 0.85, 1e-10, 200
MAX_BENCH, UNKNOWN_BENCH = 7, 2
#: Iterations between two tables in the shared folder.
CUT = 2
#: The same for steps that read their input once.
STEPS = 10


def merged_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, w): parallel edges by their largest weight; loops and weights that are not positive left out."""
    return edges.filter((F.col("src") != F.col("dst")) & (F.col("w") > 0)).groupBy("src", "dst").agg(F.max("w").alias("w"))


def _step(edges: DataFrame, nodes: DataFrame, pr: DataFrame, n: int) -> DataFrame:
    """One iteration: the mass of nodes without an out-edge is spread over all."""
    sent = edges.join(pr, edges["src"] == pr["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pr") * F.col("share")).alias("got"))
    dangling = pr.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti").agg(F.coalesce(F.sum("pr"), F.lit(0.0)).alias("loose"))
    all_ = nodes.join(sent, "id", "left").withColumn("loose", dangling.scalar())
    return all_.select("id", ((1 - DAMPING) / n + DAMPING * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("pr"))


def _without_loose(edges: DataFrame, nodes: DataFrame, y: DataFrame, n: int) -> DataFrame:
    """One step that leaves the mass of nodes without an out-edge aside: it reads ``y`` once, so steps chain without doubling the plan."""
    sent = edges.join(y, edges["src"] == y["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pr") * F.col("share")).alias("got"))
    return nodes.join(sent, "id", "left").select("id", ((1 - DAMPING) / n + DAMPING * F.coalesce("got", F.lit(0.0))).alias("pr"))


def _scaled(y: DataFrame) -> DataFrame:
    total = y.agg(F.sum("pr").alias("total"))
    return y.select("id", (F.col("pr") / total.scalar()).alias("pr"))


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, iterations: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, pr), summing to 1: a fixed number of power iterations, or until the change is below the tolerance.

    Spreading the mass of nodes without an out-edge evenly only scales the
    result, so the converging form solves the system without it and scales at
    the end.  Every few steps a table is written to the shared folder: the plan
    stays short, and a lost executor costs a re-read.
    """
    merged = merged_edges(edges)
    out = merged.groupBy("src").agg(F.sum("w").alias("total"))
    shared = materialise(merged.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "edges")
    ids = shared.select(F.col("src").alias("id")).union(shared.select("dst"))
    if nodes is not None:
        ids = ids.union(nodes.select("id"))
    ids = materialise(ids.filter("id is not null").distinct(), "nodes")
    n = ids.count()
    if n == 0:
        return ids.withColumn("pr", F.lit(0.0))
    pr = ids.withColumn("pr", F.lit(1.0 / n))
    if iterations is not None:
        for i in range(1, iterations + 1):
            pr = _step(shared, ids, pr, n)
            if i % CUT == 0:
                pr = materialise(pr, "pagerank")
        return pr
    total = 1.0
    for _ in range(ITERATIONS // STEPS):
        new = pr
        for _ in range(STEPS):
            new = _without_loose(shared, ids, new, n)
        new = materialise(new, "pagerank")
        was, total = total, new.agg(F.sum("pr")).first()[0]
        change = new.join(pr.withColumnRenamed("pr", "old"), "id").agg(F.sum(F.abs(F.col("pr") / total - F.col("old") / was))).first()[0]
        pr = new
        if change < tolerance:
            break
    return _scaled(pr)


def bench_weight(bench: Column) -> Column:
    """Larger benches weigh more, up to the largest; an unknown one as two judges."""
    return F.least(F.lit(1.0), F.log1p(F.coalesce(F.nullif(bench, F.lit(0)), F.lit(UNKNOWN_BENCH)).cast("double")) / F.log1p(F.lit(float(MAX_BENCH))))


def authority(pr: DataFrame, benches: DataFrame) -> DataFrame:
    """(id, authority): ln(1 + N * PageRank * bench weight), scaled to a largest of 1."""
    raw = pr.join(benches, "id", "left").select("id", "pr", bench_weight(F.col("bench")).alias("bw"))
    n = pr.agg(F.count(F.lit(1)).alias("n"))
    scored = raw.withColumn("a", F.log1p(n.scalar() * F.col("pr") * F.col("bw")))
    top = scored.agg(F.max("a").alias("top"))
    return scored.select("id", F.coalesce(F.col("a") / F.nullif(top.scalar(), F.lit(0.0)), F.lit(0.0)).alias("authority"))
