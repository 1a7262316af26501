"""DataFrame jobs for numeric-QA, retrieval and tool-trace datasets on Spark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to the executors by value, so that a cluster
# needs no installed copy of it.
register_pickle_by_value(sys.modules[__name__])
