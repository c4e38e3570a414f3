"""Benchmark: headline corpus-analytics jobs on the driver tables.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.

Each job is forced with the ``noop`` sink (every column computed, nothing
collected). Cross-validation timings cover fold fitting + prediction + summary
on a checkpointed model input, like the reference's "balanced -> overall"
interval; the feature preparation is timed as its own entry.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpuslab.session import drop_stage_tables, local_session  # noqa: E402


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(results: dict, name: str, fn) -> None:
    t0 = time.perf_counter()
    fn()
    results[name] = round(time.perf_counter() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=max(2 * cpus, 8))

    from corpuslab.operators import evaluation, models, stylistics
    from corpuslab.plans import classification, clustering, features
    from corpuslab.plans.descriptives import class_comparison_report
    from corpuslab.sources import bindings

    docs = bindings.table(spark, sf_dir, "documents")
    res: dict[str, float] = {}

    # warm-up: JVM start, parquet footers, Python workers
    force(docs.select("doc_id").limit(10))
    force(stylistics.stylistics_of(docs.select("doc_id", "lang", "text").limit(50), num_partitions=cpus))

    def bow_tables():
        # one count table (written once), then MFW-100, MFW-500 and TF-IDF-5000 from it
        tables = features.bow_features(docs)
        for name in ("mfw_100", "mfw_500", "tfidf_5000"):
            force(tables[name])

    def styl():
        force(stylistics.stylistics_of(docs.select("doc_id", "lang", "text"), num_partitions=2 * cpus))

    timed(res, "bow_mfw100_mfw500_tfidf5000", bow_tables)
    timed(res, "stylistics_table", styl)
    timed(res, "descriptives_report", lambda: force(class_comparison_report(spark, sf_dir, num_partitions=2 * cpus)))

    for fs in ("stylistics", "mfw_100", "tfidf_5000", "embeddings"):
        holder = {}
        timed(res, f"prep_{fs}", lambda fs=fs: holder.update(
            inp=classification.classification_input(spark, sf_dir, fs, num_partitions=2 * cpus)))
        data, featurizer, _names, classes = holder["inp"]

        def cv(data=data, featurizer=featurizer, classes=classes):
            preds, _ = models.cross_validate(data, featurizer, classes)
            force(evaluation.cv_summary(preds))

        timed(res, f"cv_rf_{fs}", cv)

    def kmeans():
        _a, scores = clustering.run_clustering(spark, sf_dir)
        force(scores)

    timed(res, "kmeans_ari_4_models", kmeans)

    total = round(sum(res.values()), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_time", "value": total, "unit": "sec", "queries": res,
                      "sf": float(sf.group(1)) if sf else sf_dir, "cpus": cpus}))
    drop_stage_tables(spark)
    spark.stop()


if __name__ == "__main__":
    main()
