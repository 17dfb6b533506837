"""tidemark: a Spark-native engine for review analytics.

Functions of the package go to executors by value, so these need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
