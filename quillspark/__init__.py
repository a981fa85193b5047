"""Spark-native analytics over media-job facts: intervals, signals, vectors, graphs, streams.

Functions sent to executors are pickled by value, so that a cluster needs no
copy of this package on its workers' path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
