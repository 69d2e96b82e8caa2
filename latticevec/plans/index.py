"""An index over vectors: projection, boxes and proximity graph, built once and searched in batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticevec.functions.vec import subspace
from latticevec.operators import beam, boxes, knn, pca
from latticevec.operators.descent import descent_graph
from latticevec.plans.config import SearchConfig
from latticevec.sources.store import Store


@dataclass
class VectorIndex:
    base: DataFrame  # (id, vec): the vectors themselves
    space: DataFrame  # (id, vec): what is searched
    graph: DataFrame  # (id, neighbors)
    config: SearchConfig
    nodes: int
    model: pca.PCA | None = None
    boxes: DataFrame | None = None

    @classmethod
    def build(cls, base: DataFrame, config: SearchConfig, graph: DataFrame | None = None, store: Store | None = None, name: str = "index") -> VectorIndex:
        """An index of (id, vec). Without a graph one is made, as the config says. With a store, parts that it has under the same name and settings are read instead."""
        store = store or Store(None)
        key = config.key(name)
        base = base.select(F.col("id").cast("long").alias("id"), "vec")
        model, space, made = None, base, None
        if config.projected:
            model = pca.PCA.from_df(store.cached(f"{key}/pca", lambda: pca.fit(base).to_df(base.sparkSession), base.sparkSession))
            dims = min(config.dims, len(model.mean))
            space = store.cached(f"{key}/space", lambda: pca.transform(base, model, dims).select("id", F.col("pca").alias("vec")), base.sparkSession)
        nodes = base.count()
        if graph is None:
            make = descent_graph if config.graph == "descent" else knn.knn_graph
            graph = store.cached(f"{key}/graph", lambda: make(space, config.degree), base.sparkSession)
        if config.entry == "box":
            capacity = int(nodes * config.point_ratio)
            points = space.select("id", F.inline(F.array(subspace(F.col("vec")))))
            made = store.cached(f"{key}/boxes", lambda: boxes.expand_boxes(boxes.kd_boxes(points, capacity), config.expand_ratio), base.sparkSession)
        return cls(base, space, graph, config, nodes, model, made)

    def project(self, queries: DataFrame) -> DataFrame:
        """(qid, vec) in the space that is searched."""
        asked = queries.select(F.col("qid").cast("long").alias("qid"), "vec")
        if self.model is None:
            return asked
        return pca.transform(asked, self.model, min(self.config.dims, len(self.model.mean))).select("qid", F.col("pca").alias("vec"))

    def box_of(self, asked: DataFrame) -> DataFrame:
        """(qid, box_id) of each projected query."""
        return boxes.box_of(asked.select("qid", F.inline(F.array(subspace(F.col("vec"))))), self.boxes)

    def entries(self, asked: DataFrame) -> DataFrame:
        """(qid, id): where each projected query starts."""
        if self.boxes is None:
            return beam.random_entries(asked, self.nodes, self.config.n_candidates)
        return boxes.entries(self.box_of(asked), self.boxes, self.config.n_candidates)

    def search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(qid, rank, id, dist) for (qid, vec). With ``rerank`` the whole beam is ranked again by the vectors themselves.

        Where a search from boxes has a beam and rounds for all rows and ranks
        them again, its end is found without writing out a beam of all rows
        for each query, and is exact.
        """
        c, k = self.config, k or self.config.k
        asked = self.project(queries)
        if self.boxes is not None and c.rerank and min(c.n_candidates, c.max_iter * c.search_width) >= self.nodes:
            starts = self.boxes.select(F.col("box_id").alias("start"), F.col("members").alias("ids"))
            begun = queries.select(F.col("qid").cast("long").alias("qid"), "vec").join(self.box_of(asked).withColumnRenamed("box_id", "start"), "qid")
            return beam.whole(begun, self.base, self.graph, starts, k)
        found = beam.search(asked, self.space, self.graph, self.entries(asked), c.n_candidates if c.rerank else k, c.n_candidates, c.search_width, c.max_iter)
        return knn.rerank(found, self.base, queries.select(F.col("qid").cast("long").alias("qid"), "vec"), k) if c.rerank else found
