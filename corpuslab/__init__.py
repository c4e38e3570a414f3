"""corpuslab: corpus analytics as Spark DataFrame operators.

Every operator takes and returns Spark DataFrames (or Columns) and is built from
Spark SQL / MLlib primitives. Sub-packages:

* ``functions``  column expressions (regexes, tagger, label recodes) and fixed lexicons
* ``sources``    readers, writers and the bindings onto the driver test tables
* ``operators``  cleaning, joins, bag-of-words, annotation, stylistics, sentiment,
                 splitting, models, evaluation, statistics
* ``plans``      the four end-to-end jobs (features, classification, clustering,
                 descriptives) and the query registry
* ``streaming``  incremental per-document featurisation with Structured Streaming
"""

__version__ = "0.1.0"
