"""A Spark-native engine for collections of notes and documents: incremental index, link
graph, hybrid retrieval, near-duplicate clustering and gated writes."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
