"""M1–M6: feature vectors, random forests with grouped CV, importances, KMeans, 2-D maps.

Everything trains with Spark MLlib (distributed fits). The driver only loops
over a bounded set of fold ids / model names and receives model summaries whose
size is bounded by the number of features (importances) — never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .stats import exact_quantiles

# The 19 stylistic features the reference's classifier uses.
CLASSIFY_STYLISTICS = [
    "nominal_verb_ratio", "msttr", "noun_ttr", "verb_ttr", "personal_pronoun_ratio", "function_word_ratio",
    "of_ratio", "that_ratio", "passive_ratio", "active_ratio", "adjective_adverb_ratio", "avg_wordlen",
    "avg_sentlen", "avg_ndd", "std_ndd", "compression_ratio", "sentiment_mean", "sentiment_std", "sentiment_abs",
]


def label_index(col: str, classes: Sequence[str]) -> Column:
    """Class name -> 0.0, 1.0, ... in the given (sorted) class order."""
    expr = None
    for i, c in enumerate(classes):
        cond = F.col(col) == F.lit(c)
        expr = F.when(cond, F.lit(float(i))) if expr is None else expr.when(cond, F.lit(float(i)))
    return expr


def index_label(col: str, classes: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.col(col).cast("int") + 1)


def vector_from_array(df: DataFrame, col: str = "embedding", out: str = "features") -> DataFrame:
    """M1 (embeddings): array<float> -> dense ML vector (JVM side)."""
    return df.withColumn(out, array_to_vector(F.col(col)))


class ColumnsFeaturizer:
    """M1 (tables of columns): median imputation fitted on the training rows + VectorAssembler.

    ``fit(train)`` returns a function that transforms any frame with the training
    medians of all columns (exact; 0 for a column without any training value), so test
    folds never leak into imputation and may have holes where the training rows have
    none. The driver gets one number a column.
    """

    def __init__(self, cols: Sequence[str], out: str = "features"):
        self.cols, self.out = list(cols), out

    def fit(self, train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        tmp = [f"_imp_{i}" for i in range(len(self.cols))]
        exprs = [f"CAST(`{c}` AS DOUBLE) AS {t}" for c, t in zip(self.cols, tmp)]
        cast = lambda d: d.selectExpr("*", *exprs)
        long = cast(train).select(*tmp).unpivot([], tmp, "feature", "value").where("value IS NOT NULL AND NOT isnan(value)")
        tied = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))  # rates are mostly zeros
        tied = materialize(tied, "median-values")
        fill = dict.fromkeys(tmp, 0.0) | {r["feature"]: r["q"] for r in exact_quantiles(tied, (0.5,), count_col="n").collect()}
        filled = [f"coalesce(nanvl({t}, NULL), {float(fill[t])!r}D) AS {t}" for t in tmp]
        va = VectorAssembler(inputCols=tmp, outputCol=self.out)

        def transform(d: DataFrame) -> DataFrame:
            return va.transform(cast(d).selectExpr(*[f"`{c}`" for c in d.columns], *filled)).drop(*tmp)

        return transform


class VectorFeaturizer:
    """M1 (precomputed vectors): identity, the column already holds ML vectors."""

    def __init__(self, col: str = "features"):
        self.col = col

    def fit(self, train: DataFrame):
        return lambda d: d if self.col == "features" else d.withColumn("features", F.col(self.col))


def train_forest(train: DataFrame, label_col: str = "_y", num_trees: int = 100, max_depth: int = 30,
                 seed: int = 42, max_bins: int = 32, max_memory_mb: int = 256):
    """M2: random forest (sqrt features per split, bootstrap) fitted with MLlib.

    Trees grow to ``max_depth``, whose default is the library's limit (30); the
    reference's trees are unlimited.

    ``max_memory_mb`` bounds the per-pass node statistics, which every running task
    holds; a larger value lets one pass over the data split more nodes (fewer jobs per
    tree level). Rows keep the node they are in of every tree, so the grown trees aren't sent along with each pass.
    """
    rf = RandomForestClassifier(featuresCol="features", labelCol=label_col, numTrees=num_trees,
                                maxDepth=max_depth, seed=seed, featureSubsetStrategy="sqrt", maxBins=max_bins,
                                maxMemoryInMB=max_memory_mb, cacheNodeIds=True)
    return rf.fit(train)


class FittedFold(NamedTuple):
    """What is kept of a fold's forest."""

    featureImportances: Vector


def fit_tasks(rows: int, cores: int, task_rows: int = 2048) -> int:
    """Tasks to deal the rows of a forest out to: one per ``task_rows``, at most half the cores.

    Every task of a fit holds statistics of all nodes of a pass, so more tasks than needed cost time and memory.
    """
    return max(1, min(-(-rows // task_rows), cores // 2))


def cross_validate(df: DataFrame, featurizer, classes: Sequence[str], label_col: str = "label",
                   fold_col: str = "fold", id_col: str = "doc_id", k: int = 5, parallelism: int | None = None,
                   **forest_kw):
    """M3: per fold fit on the other folds, predict the fold; returns (predictions DataFrame (fold, doc_id, label, prediction), list of (fold, FittedFold)).

    A forest has about as many nodes as rows x trees / 4, which the driver holds: its predictions are written once it is fitted,
    and only the importances stay. ``parallelism`` fits run concurrently, by default as many as the cores have room for: two if
    ``df``, which each fit reads again and again, is dealt out to ``fit_tasks``' most tasks.
    """
    d = df.withColumn("_y", label_index(label_col, classes))
    if parallelism is None:
        parallelism = df.sparkSession.sparkContext.defaultParallelism // max(1, df.rdd.getNumPartitions())

    def one(i: int):
        train, test = d.where(F.col(fold_col) != i), d.where(F.col(fold_col) == i)
        feat = featurizer.fit(train)
        model = train_forest(feat(train), **forest_kw)
        pred = materialize(model.transform(feat(test)).select(
            F.lit(i).cast("bigint").alias("fold"), id_col, label_col,
            index_label("prediction", classes).alias("prediction")), "fold-predictions")
        return i, FittedFold(model.featureImportances), pred

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, k))) as pool:
        results = list(pool.map(one, range(k)))
    preds = None
    for _i, _m, p in results:
        preds = p if preds is None else preds.unionByName(p)
    return preds, [(i, m) for i, m, _p in results]


def mean_importances(spark: SparkSession, models, names: Sequence[str], top: int = 20) -> DataFrame:
    """M4: importances averaged over folds, top ``top`` (bounded: folds × features values); ``models``: (fold, FittedFold or model)."""
    rows = []
    for fold, m in models:
        imp = m.featureImportances.toArray()
        rows += [(int(fold), names[j], float(imp[j])) for j in range(len(names))]
    df = spark.createDataFrame(rows, "fold bigint, feature string, importance double")
    return (df.groupBy("feature").agg(F.avg("importance").alias("importance"))
            .orderBy(F.desc("importance"), F.asc("feature")).limit(top))


def with_nearest(assigned: DataFrame, centres: np.ndarray, vec_col: str) -> DataFrame:
    """``assigned`` (..., cluster, vector) with ``nearest``: whether no centre is closer than that of ``cluster``.

    The centres, which the fit holds on the driver, go to each worker once; distances are a matrix product a batch.
    """
    shared = assigned.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*assigned.schema.fields, T.StructField("nearest", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, (1 << 22) // len(c))):
                b = whole.slice(at, max(1, (1 << 22) // len(c)))
                x = b.column(vec_col).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                gaps = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
                own = gaps[np.arange(len(x)), b.column("cluster").to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own <= gaps.min(1) + 1e-9)], names=schema.names)

    return assigned.mapInArrow(run, schema)


def kmeans_by_truth(df: DataFrame, truth: str, vec_col: str = "embedding", by: str = "model",
                    seed: int = 42, max_iter: int = 300, tol: float = 1e-4, parallelism: int = 4) -> DataFrame:
    """M5: per ``by`` value, KMeans with k = number of distinct ``truth`` values.

    Returns (by, doc_id, truth, cluster, nearest): ``nearest`` says that no other
    centre is closer. The driver loops over the (bounded) distinct model names and
    submits the fits concurrently; each fit is distributed (MLlib caches its own
    vector RDD for the iterations). One truth value: all rows are cluster 0.
    The library keeps all k centres on the driver and sends them to every task, so k
    (the number of truth values) is limited by memory: k x dimension doubles.
    """
    names = [r[0] for r in df.select(by).distinct().orderBy(by).collect()]

    def one(m):
        part = vector_from_array(df.where(F.col(by) == m), vec_col)
        k = int(part.select(F.count_distinct(truth)).first()[0])
        if k < 2:
            return part.select(F.lit(m).alias(by), "doc_id", truth, F.lit(0).cast("bigint").alias("cluster"), F.lit(True).alias("nearest"))
        km = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="features", predictionCol="cluster").fit(part)
        found = with_nearest(km.transform(part).select("doc_id", truth, "cluster", vec_col), np.array(km.clusterCenters()), vec_col)
        return found.select(F.lit(m).alias(by), "doc_id", truth, F.col("cluster").cast("bigint"), "nearest")

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(names)))) as pool:
        parts = list(pool.map(one, names))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def project_pca(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """M6 without neighbours: L2 normalisation (cosine geometry) then PCA(k=2), as a table (doc_id, x, y, + input columns).

    The map from the neighbour graph is ``layout.neighbour_map``.
    """
    v = vector_from_array(df, vec_col, "_v")
    n = Normalizer(p=2.0, inputCol="_v", outputCol="_n").transform(v)
    p = PCA(k=2, inputCol="_n", outputCol="_p").fit(n).transform(n)
    arr = vector_to_array("_p")
    return p.withColumn("x", arr[0]).withColumn("y", arr[1]).drop("_v", "_n", "_p")


class BowFeaturizer:
    """M1 for bag-of-words with the vocabulary fitted on the training rows only.

    Input rows carry ``terms`` (array) and ``n_terms``. ``fit(train)`` takes the
    top-N terms of the training documents (distributed count, N names collected)
    and returns a transform: ``mfw`` -> dense relative frequencies over the N
    terms (0/0 -> 0); ``tfidf`` -> smoothed idf of the training documents,
    L2-normalised sparse vectors.
    """

    def __init__(self, kind: str, n: int):
        if kind not in ("mfw", "tfidf"):
            raise ValueError(kind)
        self.kind, self.n = kind, n

    def fit(self, train: DataFrame):
        from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
        from pyspark.ml.linalg import Vectors

        counts = (train.select("doc_id", F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
                  .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n")))
        top = (counts.groupBy("term").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("df"))
               .orderBy(F.desc("total"), F.asc("term")).limit(self.n).collect())  # bounded: N rows
        terms = [r["term"] for r in top]
        cv = CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="_tf")
        if self.kind == "mfw":
            def transform(d: DataFrame) -> DataFrame:
                rel = F.transform(vector_to_array("_tf"),
                                  lambda x: F.when(F.col("n_terms") > 0, x / F.col("n_terms")).otherwise(F.lit(0.0)))
                return cv.transform(d).withColumn("features", array_to_vector(rel)).drop("_tf")
            return transform
        import math
        n_docs = train.count()
        idf = [math.log((1.0 + n_docs) / (1.0 + r["df"])) + 1.0 for r in top]
        ep = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_w")
        nz = Normalizer(p=2.0, inputCol="_w", outputCol="features")
        return lambda d: nz.transform(ep.transform(cv.transform(d))).drop("_tf", "_w")
