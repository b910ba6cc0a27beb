"""churnkit: member-attrition analytics expressed as Spark DataFrame operators.

Every operator takes and returns a ``pyspark.sql.DataFrame``. Sub-packages:

* ``sources``   – table readers, the stand-in member tables, CSV/JSON readers and sinks
* ``functions`` – column-level helpers (target predicate, date parsing, p-values, ranks)
* ``operators`` – profiles, data quality, association tests, recoding, split, oversampling,
                  models, metrics, comparison, interpretation
* ``plans``     – experiment plan (algorithm grid) and the end-to-end job
* ``streaming`` – Structured Streaming scoring of new members
"""

__version__ = "0.1.0"
