"""Adaptive graph memory and large-scale record processing on Apache Spark.

Sub-packages
------------
``operators``  relational building blocks: temporal graph, traversal, spreading
               activation, learning, maintenance, and the data-quality operators
               (nested records, orphans, skewed keys, snapshots, periods)
``functions``  scalar expressions and lookup rules
``sources``    readers and writers (operation log, entities, assets, exports)
``plans``      named queries over the project's tables with their reference SQL
``streaming``  Structured Streaming jobs
"""

__version__ = "0.1.0"
