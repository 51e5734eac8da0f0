"""Siltstone: a Spark-native engine for retrieval, evidence and literature analytics."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to executors by value: a cluster needs no copy of the package on its nodes.
register_pickle_by_value(sys.modules[__name__])
