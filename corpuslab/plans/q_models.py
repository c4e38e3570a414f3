"""Queries for M1–M6 and the classification / clustering jobs.

A fitted model has no SQL form; these entries run the whole job and return what SQL
can say about its result: the rows it must cover, and what must hold for each.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import layout, models, neighbours
from ..session import materialize
from .classification import classification_input, run_classification
from .clustering import cluster_documents, embed_documents, projection_sample, run_clustering, run_projection
from .registry import finish, parallelism, register


def _vector_cells(spark, sf):
    data, featurizer, names, _ = classification_input(spark, sf, "stylistics", num_partitions=parallelism(spark))
    v = featurizer.fit(data)(data)
    cells = v.select("doc_id", F.posexplode(vector_to_array("features")).alias("pos", "value"))
    feature = F.get(F.array(*[F.lit(n) for n in names]), F.col("pos"))
    return cells.select("doc_id", feature.alias("feature"), "value")


@register("feature_vector", oracle=False)
def q_feature_vector(spark, sf):
    """M1: the assembled stylistic vectors of the balanced rows after median imputation, listed by feature."""
    return finish(_vector_cells(spark, sf))


@register("feature_vector_measures")
def q_feature_vector_measures(spark, sf):
    """M1: the same list without the compression ratio, which SQL can't express."""
    return finish(_vector_cells(spark, sf).where("feature <> 'compression_ratio'"))


@register("train_forest", oracle=False)
def q_train_forest(spark, sf):
    """M2: one forest on all balanced stylistic rows: each row's prediction and the probability of its own class."""
    data, featurizer, _names, classes = classification_input(spark, sf, "stylistics", num_partitions=parallelism(spark))
    d = data.withColumn("_y", models.label_index("label", classes))
    v = featurizer.fit(d)(d)
    m = models.train_forest(v)
    own = F.get(vector_to_array("probability"), F.col("_y").cast("int"))
    return finish(m.transform(v).select("doc_id", "label", models.index_label("prediction", classes).alias("prediction"), own.alias("own_probability")))


@register("cross_validate", oracle=False)
def q_cross_validate(spark, sf):
    """M3: five-fold predictions on the stylistic features."""
    preds, _summary, _imp = run_classification(spark, sf, "stylistics", num_partitions=parallelism(spark))
    return finish(preds.select("fold", "doc_id", "label", "prediction"))


@register("mean_importances", oracle=False)
def q_mean_importances(spark, sf):
    """M4: mean importances over folds (stylistic features)."""
    _p, _s, imp = run_classification(spark, sf, "stylistics", num_partitions=parallelism(spark))
    return finish(imp.select("feature", "importance"))


@register("kmeans_by_truth")
def q_kmeans_by_truth(spark, sf):
    """M5: every row's cluster is within k, and no returned centre is nearer than its own."""
    a = run_clustering(spark, sf)[0]
    k = a.groupBy("model").agg(F.count_distinct("emb_label").alias("k"))
    return finish(a.join(k, "model").select("model", "doc_id", "emb_label", "nearest",
                                            F.col("cluster").between(0, F.col("k") - 1).alias("within_k")))


@register("project_2d")
def q_project_2d(spark, sf):
    """M6: map of a seeded sample of groups from its neighbour graph: every row is placed, and linked points lie near one another.

    (``more_near_than_pca``: of the graph's edges, more are shorter than a quarter of the points' root mean square
    distance than between the same points' principal components.)
    """
    graph = {}
    p = materialize(run_projection(spark, sf, graph_out=graph), "map")
    pts = graph["points"].select("idx", F.col("id").alias("doc_id"), "v")

    def near(places):
        x = places.select(F.col("idx").alias("i"), "x", "y"), places.select(F.col("idx").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        length = F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2)
        usual = places.agg(2 * (F.var_samp("x") + F.var_samp("y"))).scalar()
        return graph["edges"].join(x[0], "i").join(x[1], "j").agg(F.avg((length < usual / 16).cast("int"))).scalar()

    more = near(pts.join(p, "doc_id")) > near(materialize(layout.principal(pts), "map-principal"))
    return finish(p.select("doc_id", "emb_label", more.alias("more_near_than_pca"),
                           (F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")).alias("placed")))


@register("neighbour_graph")
def q_neighbour_graph(spark, sf):
    """M6: distances of each sampled embedding to its nearest neighbours, as the graph of the map has them."""
    pts = neighbours.points(projection_sample(spark, sf), "doc_id", "embedding")
    g = neighbours.neighbour_graph(pts).join(pts.select(F.col("idx").alias("i"), F.col("id").alias("doc_id")), "i")
    g = g.select("doc_id", F.posexplode("near").alias("pos", "x"))
    return finish(g.select("doc_id", (F.col("pos") + 1).alias("rank"), F.col("x.d").alias("distance")))


@register("project_pca")
def q_project_pca(spark, sf):
    """M6 by principal components: the first axis has no less variance than the second."""
    p = run_projection(spark, sf, method="pca")
    spread = p.agg(F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    ordered = p.withColumns({"vx": spread.select("vx").scalar(), "vy": spread.select("vy").scalar()})
    return finish(ordered.select("doc_id", "emb_label", (F.col("vx") >= F.col("vy")).alias("ordered"),
                                 (F.col("x").isNotNull() & F.col("y").isNotNull()).alias("placed")))


@register("cluster_scores")
def q_cluster_scores(spark, sf):
    """E-3 job: per embedding model, groups, clusters within their number, scores within their bounds."""
    s = run_clustering(spark, sf)[1]
    return finish(s.select("model", "n_groups", (F.col("n_clusters") <= F.col("n_groups")).alias("within_k"),
                           (F.col("ari").between(-1, 1) & F.col("v_measure").between(0, 1.000001)).alias("in_bounds")))


@register("text_embeddings", oracle=False)
def q_text_embeddings(spark, sf):
    """32-dimensional embeddings of all documents by a truncated SVD of their TF-IDF weights."""
    return embed_documents(spark, sf)


@register("cluster_text_embeddings", oracle=False)
def q_cluster_text_embeddings(spark, sf):
    """E-3 job on embeddings made from the texts."""
    return finish(cluster_documents(spark, sf))


def _classify(feature_set, min_words=None, vocab_from="all"):
    def fn(spark, sf):
        s = run_classification(spark, sf, feature_set, min_words, vocab_from=vocab_from, num_partitions=parallelism(spark))[1]
        return finish(s.select("metric", "class", "n_folds",
                               (F.col("mean").between(0, 1) & F.col("std").between(0, 0.5)).alias("in_bounds")))
    fn.__doc__ = (f"E-2 job: CV summary for {feature_set}" + (f", >= {min_words} words" if min_words else "")
                  + (", vocabulary fitted on training folds" if vocab_from == "train" else "")
                  + ": metric rows, folds and bounds")
    return fn


for _fs in ("stylistics", "mfw_100", "mfw_500", "tfidf_5000", "embeddings"):
    register(f"classify_{_fs}")(_classify(_fs))
for _fs in ("stylistics", "mfw_100", "tfidf_5000", "embeddings"):
    register(f"classify_{_fs}_min100")(_classify(_fs, 100))
for _fs in ("tfidf_5000", "mfw_100"):
    register(f"classify_{_fs}_train_vocab")(_classify(_fs, vocab_from="train"))


@register("feature_tables")
def q_feature_tables(spark, sf):
    """E-1 job: every feature table written once (parquet); rows and value sums of what was written."""
    from ..session import scratch_path
    from .features import build_feature_tables

    paths = build_feature_tables(spark, sf, scratch_path(spark, "features"), num_partitions=parallelism(spark))
    value = {"mfw_100": "rel_freq", "mfw_500": "rel_freq", "tfidf_5000": "weight", "stylistics": "msttr", "embeddings": "embedding[0]"}
    out = None
    for name, v in sorted(value.items()):
        t = spark.read.parquet(paths[name]).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"),
                                                F.sum(F.expr(f"CAST({v} AS DOUBLE)")).alias("total"))
        out = t if out is None else out.unionByName(t)
    return finish(out, 4)


@register("feature_profile", oracle=False)
def q_feature_profile(spark, sf):
    """E-1 job: the profile of the stylistics table (D8 and P17 per column)."""
    from .features import feature_profile, stylistics_features

    return finish(feature_profile(stylistics_features(spark, sf, num_partitions=parallelism(spark))))


@register("feature_profile_measures")
def q_feature_profile_measures(spark, sf):
    """E-1 job: the same profile without the compression ratio, which SQL can't express."""
    from .features import feature_profile, stylistics_features

    t = stylistics_features(spark, sf, with_compression=False, num_partitions=parallelism(spark))
    return finish(feature_profile(t.drop("compression_ratio")))


@register("class_comparison", oracle=False)
def q_class_comparison(spark, sf):
    """E-4 job (flagship): per-feature class statistics, pooled t, df and two-sided p."""
    from .descriptives import class_comparison_report

    return finish(class_comparison_report(spark, sf, num_partitions=parallelism(spark)))


@register("class_comparison_measures")
def q_class_comparison_measures(spark, sf):
    """E-4 job: the same report without the compression ratio, which SQL can't express."""
    return finish(q_class_comparison(spark, sf).where("feature <> 'compression_ratio'"))
