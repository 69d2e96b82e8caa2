"""The library's operators as queries over the driver's tables: every row of ``embeddings`` is a base vector and a query."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticevec.functions import bits, vec
from latticevec.lineage import checkpoint, remove, shared_dir
from latticevec.operators import beam, boxes, descent, knn, metrics, pca, tune
from latticevec.plans.config import SearchConfig
from latticevec.plans.index import VectorIndex
from latticevec.sources import formats, logs

K, DEGREE, WIDTH = 10, 16, 128
#: A fixed projection to three dimensions, by rows.
MATRIX = [[((7 * i + 13 * j) % 11 - 5) / 10 for j in range(3)] for i in range(64)]
DIMS = range(1, 65)
TRAINING, CAPACITY = 100, 25


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select(F.col("id").alias("qid"), "vec")


def points(spark: SparkSession, sf_dir: str, key: str = "id") -> DataFrame:
    return base(spark, sf_dir).select(F.col("id").alias(key), "label", F.inline(F.array(vec.subspace(F.col("vec"))))).select(key, "label", *[F.col(a).cast("double") for a in boxes.AXES])


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def nearest(spark: SparkSession, sf_dir: str, k: int = K, dims: int | None = None, skip_self: bool = False) -> DataFrame:
    return knn.exact_knn(base(spark, sf_dir), asked(spark, sf_dir), k, dims, skip_self)


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nearest(spark, sf_dir), "dist")


def knn_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nearest(spark, sf_dir, dims=32), "dist")


def centroid_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    dims = rows.select("label", F.posexplode("vec").alias("p", "x")).groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("c"))
    # One row for each label, of which there are ten in all tables.
    pairs = rows.select("id", "vec").crossJoin(F.broadcast(centres))
    return pairs.select("id", "label", F.round(vec.squared_l2(F.col("vec"), F.col("c")), 6).alias("dist"))


def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.graph_edges(knn.knn_graph(base(spark, sf_dir), DEGREE))


def knn_graph_by_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.graph_edges(descent.descent_graph(base(spark, sf_dir), DEGREE))


def graph_without_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = knn.knn_graph(base(spark, sf_dir), 4)
    nodes = graph.count()
    return knn.graph_edges(graph.withColumn("neighbors", F.concat("neighbors", F.array(F.lit(nodes).cast("long"), F.lit(nodes + 1).cast("long")))), nodes)


def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.in_degree(knn_graph(spark, sf_dir))


def graph_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = checkpoint(knn.graph_edges(knn.knn_graph(base(spark, sf_dir), 8)))
    first = edges.select(F.col("id").alias("qid"), F.col("neighbor").alias("id"))
    visited = first.union(base(spark, sf_dir).select("id", "id")).distinct()
    return knn.expand(first, edges, visited)


def column_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pca.column_mean(base(spark, sf_dir)), "mean")


def center_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    _, mean, _ = pca.moments(rows)
    return rows.select("id", F.posexplode(vec.subtract(F.col("vec"), vec.vector(mean))).alias("dim", "x")).select("id", "dim", F.round("x", 6).alias("x"))


def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, cov = pca.moments(base(spark, sf_dir))
    made = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(i, len(cov))]
    return rounded(spark.createDataFrame(made, "i int, j int, cov double"), "cov")


def project_fixed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).select("id", vec.times(F.col("vec"), MATRIX).alias("p"))
    return rows.select("id", *[F.round(F.col("p")[k], 6).alias(a) for k, a in enumerate(boxes.AXES)])


def gemm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).select("id", vec.gemm(F.col("vec"), MATRIX, 2.0, 1.0, vec.leading(F.col("vec"), 3)).alias("p"))
    return rows.select("id", *[F.round(F.col("p")[k], 6).alias(a) for k, a in enumerate(boxes.AXES)])


def subspace_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(base(spark, sf_dir).select("id", F.inline(F.array(vec.subspace(F.col("vec"), 1)))).select("id", *[F.col(a).cast("double") for a in boxes.AXES]), *boxes.AXES)


def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", F.posexplode(vec.quantised(F.col("vec"), 400.0)).alias("dim", "q"))


def beam_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", vec.next_power_of_two(F.col("id") + 1).alias("length"))


def id_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = boxes.dense_numbers(base(spark, sf_dir), "label")  # ten labels
    return base(spark, sf_dir).join(F.broadcast(numbers), "label").select("id", F.col("number").cast("int").alias("number"))


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(boxes.bounds(points(spark, sf_dir)))


def flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(f"{s}.{a}"), 6).alias(f"{s}_{a}") for s in ("lo", "hi") for a in boxes.AXES])


def label_boxes(spark: SparkSession, sf_dir: str, ratio: float = 0.0) -> DataFrame:
    """A box for each label over all its points, wider (or narrower) by a ratio, with its members."""
    made = boxes.tight_boxes(points(spark, sf_dir).withColumnRenamed("label", "box_id"), "box_id", members=True)
    return boxes.expand_boxes(made, ratio) if ratio else made


def tight_boxes_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(label_boxes(spark, sf_dir), "box_id")


def expand_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(label_boxes(spark, sf_dir, 0.2), "box_id")


def box_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.histogram(label_boxes(spark, sf_dir))


def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.points_in_boxes(points(spark, sf_dir, "qid"), label_boxes(spark, sf_dir, -0.3))


def box_entry_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.box_of(points(spark, sf_dir, "qid"), label_boxes(spark, sf_dir, -0.3))


def box_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = checkpoint(label_boxes(spark, sf_dir, -0.3))
    return boxes.entries(boxes.box_of(points(spark, sf_dir, "qid"), made), made, WIDTH)


def hit_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = checkpoint(label_boxes(spark, sf_dir, -0.3))
    return boxes.running_offsets(boxes.points_in_boxes(points(spark, sf_dir, "qid"), made), boxes.histogram(made))


def global_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.global_offsets(boxes.histogram(label_boxes(spark, sf_dir)))


def candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = knn.score(box_candidates(spark, sf_dir), base(spark, sf_dir), asked(spark, sf_dir))
    return rounded(knn.ranked(scored, K).select("qid", "rank", "id", "dist"), "dist")


def kd_split_level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    b = boxes.bounds(rows, 0.0).first()
    widths = [b["hi"][a] - b["lo"][a] for a in boxes.AXES]
    axis = widths.index(max(widths))
    mid = (b["lo"][axis] + b["hi"][axis]) / 2
    value = F.col(boxes.AXES[axis])
    return rows.agg(F.lit(axis).alias("axis"), F.round(F.lit(mid), 6).alias("mid"), metrics.count_at_or_below(value, F.lit(mid)).alias("n_at_or_below"), F.count(F.lit(1)).alias("n"))


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.recall(nearest(spark, sf_dir, dims=32), nearest(spark, sf_dir), K), "recall")


def recall_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = base(spark, sf_dir).select(F.col("id").alias("qid"), "label")
    return rounded(metrics.recall_by(nearest(spark, sf_dir, dims=32), nearest(spark, sf_dir), K, groups, "label"), "recall")


def mean_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.candidate_report(checkpoint(box_candidates(spark, sf_dir)), nearest(spark, sf_dir), K), "recall", "mean_candidates")


def rerank_truncated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.rerank(nearest(spark, sf_dir, 32, 16), base(spark, sf_dir), asked(spark, sf_dir), K), "dist")


def _beam(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    flag = lambda df, done: df.select("qid", "id", F.round("dist", 6).alias("dist"), done.alias("expanded"))
    return flag(nearest(spark, sf_dir, K, 16), F.col("rank") % 2 == 0), flag(nearest(spark, sf_dir, K, 32), F.lit(False))


def merge_beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.merge_beams(*_beam(spark, sf_dir), 12).select("qid", "rank", "id", "dist", "expanded")


def frontier_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.frontier(_beam(spark, sf_dir)[0], 3)


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tune.training_sample(base(spark, sf_dir), TRAINING).select(F.col("id").alias("qid"), "vec")


def dimension_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tune.dimension_recalls(base(spark, sf_dir), training(spark, sf_dir), DIMS, WIDTH, K), "recall")


def min_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tune.least_dimension(tune.dimension_recalls(base(spark, sf_dir), training(spark, sf_dir), DIMS, WIDTH, K), 0.99)


def random_entry_lcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asked(spark, sf_dir)
    return beam.random_entries(rows, rows.count(), 16)


def lcg_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", bits.lcg(F.col("id")).alias("state"), bits.random_id(bits.lcg(F.col("id")), F.lit(10), F.lit(1000)).alias("random_id"))


def bloom_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = F.array(*[bits.filter_slot(F.col("id"), h) for h in range(bits.FILTER_HASHES)])
    rows = base(spark, sf_dir).select("id", F.posexplode(slots).alias("h", "slot"))
    return rows.select("id", "h", "slot", bits.filter_word(F.col("slot")).alias("word"), bits.filter_bit(F.col("slot")).alias("bit"))


def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = base(spark, sf_dir).count()
    m, entries = F.lit(32.0) * F.pow(F.lit(2.0), F.col("id")), F.lit(float(n))
    rows = spark.range(1, 12).select(F.col("id").cast("int").alias("i"), m.alias("m"), (m / entries).alias("r"))
    rows = rows.withColumn("k", F.greatest(bits.best_hashes(F.col("r")), F.lit(1.0))).withColumn("rate", bits.rate(F.col("k"), F.col("r")))
    p = F.lit(0.01)
    return rows.select("i", "m", F.round("r", 6).alias("r"), "k", F.round("rate", 6).alias("rate"), F.round(bits.bits_an_entry(p, F.col("k")), 6).alias("bits_an_entry"), bits.bits_for(entries, p).cast("long").alias("bits_for"), bits.entries_for(F.col("m"), F.col("k"), p).cast("long").alias("entries_for"))


def log_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("time stage"), (F.col("label") % 3).cast("string"), F.lit(": "), F.col("id").cast("string"), F.lit(" ms"))
    rows = logs.parse_log(base(spark, sf_dir).select(line.alias("value")))
    return rounded(metrics.mean_over_repeats(rows), "ms")


def training_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.exact_knn(base(spark, sf_dir), training(spark, sf_dir), 100), "dist")


def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pca.fit(base(spark, sf_dir))
    rows = [(k + 1, float(model.eigenvalues[k]), model.ratio(k + 1)) for k in range(len(model.eigenvalues))]
    return spark.createDataFrame(rows, "components int, eigenvalue double, ratio double")


def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What doesn't depend on the signs of components: the eigenvalues' sum and squares, and the whole of the ratio."""
    return rounded(pca_explained(spark, sf_dir).agg(F.sum("eigenvalue").alias("total"), F.sum(F.col("eigenvalue") * F.col("eigenvalue")).alias("squares"), F.max("ratio").alias("ratio")), "total", "squares", "ratio")


def pca_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's squared distance from the mean, and whether all its components together are as long but for rounding."""
    rows, model = base(spark, sf_dir), pca.fit(base(spark, sf_dir))
    centred = vec.subtract(F.col("vec"), vec.vector(model.mean))
    made = pca.transform(rows.select("id", "vec"), model, len(model.mean)).withColumn("length", vec.dot(centred, centred))
    return made.select("id", F.round("length", 6).alias("length"), (F.abs(vec.dot(F.col("pca"), F.col("pca")) - F.col("length")) < 1e-5).alias("same"))


def vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written to every layout of files and read again: (kind, id, dims, total of the components).

    Files hold no ids, but rows in the order of their ids, by which a row's number gives its id back.
    """
    formats.register(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    rows = base(spark, sf_dir).repartitionByRange(3, "id").sortWithinPartitions("id")
    # In single precision, like the components: a float times an integer is a double in Spark.
    whole = rows.select("id", F.transform("vec", lambda x: F.floor(F.abs(x * F.lit(100).cast("float"))).cast("int")).alias("vec"))
    out = []
    for kind in formats.KINDS:
        made = whole if kind in ("ivecs", "bvecs", "nsw") else rows.select("id", "vec")
        made.write.format("vectors").option("kind", kind).mode("append").save(f"{folder}/{kind}")
        reader = spark.read.format("vectors").option("kind", kind)
        if kind == "nsw":  # a file of its own tells how many rows it has
            formats.merge(f"{folder}/nsw", f"{folder}/one.nsw")
            read = reader.option("rows", rows.count()).load(f"{folder}/one.nsw")
        else:
            read = reader.load(f"{folder}/{kind}")
        out.append(read.select(F.lit(kind).alias("kind"), "id", F.size("vec").alias("dims"), F.round(vec.total(F.col("vec").cast("array<double>")), 4).alias("total")))
    read = checkpoint(reduce(DataFrame.unionAll, out))
    remove(spark, folder)
    starts = boxes.global_offsets(base(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id")
    numbers = starts.select("id", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("number"))
    return read.withColumnRenamed("id", "number").join(numbers, "number").select("kind", "id", "dims", "total")


def config(**more) -> SearchConfig:
    return SearchConfig.algorithm(**({"number": 1, "dims": 48, "degree": 32, "n_candidates": WIDTH, "topk": K, "search_width": 4, "point_ratio": 0.05} | more))


def kd_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = boxes.kd_boxes(points(spark, sf_dir), CAPACITY)
    return flat(made.withColumn("n", F.size("members")), "box_id", "n")


def kd_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.kd_boxes(points(spark, sf_dir), CAPACITY).select("box_id", F.explode("members").alias("id"))


def _search(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    index = VectorIndex.build(base(spark, sf_dir), config(**more))
    return index.search(asked(spark, sf_dir))


def beam_search_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_search(spark, sf_dir, number=0), "dist")


def beam_search_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir)


def beam_search_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, number=2)


def beam_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, rerank=True)


def beam_whole_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a beam for all rows, rounds to expand them all and distances of whole vectors the search is exact, whatever it starts from and in."""
    n = base(spark, sf_dir).count()
    return rounded(_search(spark, sf_dir, rerank=True, n_candidates=n, max_iter=n), "dist")


def beam_whole_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_search(spark, sf_dir, number=2, rerank=True, n_candidates=base(spark, sf_dir).count()), "dist")


def beam_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.recall(_search(spark, sf_dir, rerank=True), nearest(spark, sf_dir), K), "recall")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        knn_exact, knn_truncated, centroid_distances, knn_graph, knn_graph_by_descent, graph_without_sentinels, in_degree, graph_two_hop, column_mean, center_vectors, covariance,
        project_fixed_matrix, gemm_rows, subspace_points, quantised, beam_length, id_remap, bounds, tight_boxes_by_label, expand_boxes, box_histogram, point_in_box,
        box_entry_with_fallback, box_candidates, hit_offsets, global_offsets, candidate_topk, kd_split_level1, recall_at_k, recall_by_label, mean_candidates, rerank_truncated_candidates,
        merge_beams, frontier_selection, dimension_recalls, min_dimension, random_entry_lcg, lcg_states, bloom_hash, bloom_params, log_averages, training_truth,
        pca_explained, pca_variance, pca_lengths, vector_files, kd_boxes, kd_members, beam_whole_box, beam_whole_random, beam_search_raw, beam_search_box, beam_search_random, beam_rerank, beam_recall,
    )
}
