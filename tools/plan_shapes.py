"""Print the physical-plan shape of the headline jobs (exchanges, broadcasts, Python nodes).

Usage: python tools/plan_shapes.py [sf_dir]   (plans only: nothing is executed except
the bounded vocabulary collects that the MFW / TF-IDF builders need).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuslab.session import local_session  # noqa: E402


def shape(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {
        "shuffle_exchanges": len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning|Exchange rangepartitioning|"
                                            r"Exchange SinglePartition|Exchange RoundRobinPartitioning", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "python_nodes": plan.count("ArrowEvalPython") + plan.count("MapInPandas") + plan.count("BatchEvalPython"),
        "windows": plan.count("Window ["),
        "subqueries": plan.count("Subquery subquery"),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    from corpuslab.operators import annotate, bow, stylistics
    from corpuslab.plans.descriptives import class_comparison_report
    from corpuslab.sources import bindings

    docs = bindings.table(spark, sf, "documents")
    d = docs.select("doc_id", "text")
    counts = bow.term_counts(d)
    jobs = {
        "term_counts": counts,
        "mfw_relative(100)": bow.mfw_relative(d, bow.top_vocabulary(counts, 100), counts=counts),
        "tfidf(5000)": bow.tfidf(d, bow.top_vocabulary(counts, 5000), counts=counts),
        "token_table": annotate.token_table(docs.select("doc_id", "lang", "text")),
        "stylistics_table": stylistics.stylistics_table(annotate.token_table(docs.select("doc_id", "lang", "text"))),
        "class_comparison_report": class_comparison_report(spark, sf),
    }
    for name, df in jobs.items():
        print(f"{name:28s} {shape(df)}")


if __name__ == "__main__":
    main()
