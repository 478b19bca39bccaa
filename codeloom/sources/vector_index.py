"""A stored vector index: an inverted file of cells around centroids, searched in a few cells or exactly.

Centroids are fitted on a bounded sample; every vector is stored in the folder of its cell. A search compares a query with the
centroids, reads the nearest few cells, as many as a sample of questions has needed, and ranks their vectors by exact distance. In exact mode it then reads those other
cells that may still hold something nearer: none nearer than the distance of the centroid less the radius of the cell.
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators import blockwise
from codeloom.operators.retrieval import BLOCK_ROWS, nearest, squared_distance

#: Cells are as many as the root of the vectors, up to this; then centroids of 1,000 numbers are 32 MB, which are broadcast.
MOST_CELLS = 4096
#: Vectors that centroids are fitted on, for each cell.
SAMPLE = 64
#: Share of true neighbours that a search is to find, and questions that the number of cells it reads is measured on.
RECALL, ASKED = 0.95, 64
#: More than rounding can add to a distance, relative to it.
SLACK = 1e-6


class VectorIndex:
    """The index of one collection in a folder: tables centres (cell, centre, radius, held) and vectors (key, vector) by cell. It is
    replaced as a whole by build(). Vectors that are null have no part in it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def build(self, vectors: DataFrame, key: str, vector: str = "embedding", *, cells: int | None = None, seed: int = 17) -> VectorIndex:
        rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"))
        n = rows.count()
        cells = cells or max(2, min(MOST_CELLS, math.isqrt(n)))
        if n == 0:
            self.spark.createDataFrame([], "cell int, centre array<double>, radius double, held long").write.mode("overwrite").parquet(f"{self.folder}/centres")
            rows.withColumn("cell", F.lit(0)).write.mode("overwrite").parquet(f"{self.folder}/vectors")
            self.spark.createDataFrame([(1,)], "probes int").write.mode("overwrite").parquet(f"{self.folder}/probes")
            return self
        points = rows.withColumn("point", array_to_vector("vector"))
        different = [r.vector for r in rows.select("vector").distinct().limit(2).collect()]
        if len(different) < 2:  # there is nothing to tell cells apart by
            return self._write(rows.withColumn("cell", F.lit(0)), different)
        step = max(1, n // (SAMPLE * cells))
        sample = points.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(step)) == 0)
        few = sample if sample.limit(cells).count() == cells else points
        model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="point", predictionCol="cell").fit(few.select("point"))
        return self._write(model.transform(points).select("key", "vector", "cell"), model.clusterCenters())._calibrate(n)

    def _calibrate(self, n: int) -> VectorIndex:
        """Finds how many cells a search has to read: of a sample of vectors, as questions, the true neighbours lie in cells whose places in
        the order of the question's cells are known, and the quantile RECALL of those places is the number."""
        share = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(max(1, n // ASKED))) == 0
        asked = self._read("vectors").where(share).select(F.col("key").alias("query"), F.col("vector").alias("q")).limit(2 * ASKED)
        asked = self.spark.createDataFrame(asked.collect(), asked.schema)
        # one more than ten, since a question finds itself
        near = nearest(self._read("vectors"), asked, top=11, key="key", vector="vector", query_key="query", query_vector="q")
        true = first_of(near.where("key <> query").select("query", "key", "distance"), 10).join(self._read("vectors").select("key", "cell"), "key")
        order = Window.partitionBy("query").orderBy("away", "cell")
        places = asked.crossJoin(F.broadcast(self._read("centres"))).select("query", "cell", F.sqrt(squared_distance(F.col("centre"), F.col("q"))).alias("away"))
        met = true.join(places.withColumn("place", F.row_number().over(order)), ["query", "cell"])
        probes = met.agg(F.percentile("place", F.lit(RECALL)).alias("p")).first().p or 1
        self.spark.createDataFrame([(math.ceil(probes),)], "probes int").write.mode("overwrite").parquet(f"{self.folder}/probes")
        return self

    def _write(self, placed: DataFrame, means: list) -> VectorIndex:
        centres = self.spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(means)], "cell int, centre array<double>")
        placed.repartitionByRange("cell", "key").write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/vectors")
        away = F.sqrt(squared_distance(F.col("vector"), F.col("centre")))
        sizes = self._read("vectors").join(F.broadcast(centres), "cell").groupBy("cell").agg(F.max(away).alias("radius"), F.count(F.lit(1)).alias("held"))
        centres.join(sizes, "cell").write.mode("overwrite").parquet(f"{self.folder}/centres")
        self.spark.createDataFrame([(1,)], "probes int").write.mode("overwrite").parquet(f"{self.folder}/probes")
        return self

    def _scored(self, cells: DataFrame, top: int) -> DataFrame:
        """query, key, distance of the nearest vectors in the cells (query, q, cell) of each query."""
        largest = self._read("centres").agg(F.max("held").alias("n")).first().n or 0
        parts = max(1, -(-largest // BLOCK_ROWS))
        held = self._read("vectors").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
        held = held.join(cells.select("cell").distinct(), "cell", "left_semi").withColumn("length", F.size("vector"))
        asked = cells.select("query", "q", "cell", F.size("q").alias("length"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        return first_of(blockwise.nearest_in(held, asked, ["cell", "part", "length"], top), top)

    def search(
        self, queries: DataFrame, *, top: int = 4, key: str = "vec_id", query_key: str = "query_id", query_vector: str = "query", probes: int | None = None, exact: bool = False
    ) -> DataFrame:
        """query_id, key, distance (squared), rank, ties by key, as retrieval.nearest gives them: from the nearest cells, or exactly."""
        centres = self._read("centres")
        probes = probes or self._read("probes").first().probes
        asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_key).alias("query"), F.col(query_vector).alias("q"))
        away = F.sqrt(squared_distance(F.col("centre"), F.col("q")))
        ranked = asked.crossJoin(F.broadcast(centres)).select("query", "q", "cell", "radius", away.alias("away"))
        ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("away", "cell")))
        found = self._scored(ranked.where(F.col("n") <= probes), top)
        if exact:
            bar = found.groupBy(F.col("query").alias("_query")).agg(F.when(F.count(F.lit(1)) == top, F.sqrt(F.max("distance"))).alias("bar"))
            near = ranked.where(F.col("n") > probes).join(bar, F.col("query") == F.col("_query"), "left")
            near = near.where(F.col("bar").isNull() | (F.col("away") - F.col("radius") <= F.col("bar") + SLACK * (1 + F.col("away"))))
            found = first_of(found.unionByName(self._scored(near, top)), top)
        rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
        return found.select(F.col("query").alias(query_key), F.col("key").alias(key), "distance", rank.alias("rank"))


def first_of(rows: DataFrame, top: int) -> DataFrame:
    """The nearest rows (query, key, distance) of each query. The limit is applied before rows are shuffled."""
    order = Window.partitionBy("query").orderBy("distance", "key")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top).drop("_n")
