"""Spark-native operators for preparing data, profiling it and training models.

Every operator is a plain function over DataFrames, so that a pipeline is
ordinary Python composition and becomes one plan for Spark's optimizer.
"""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python workers travel with the job, so
# executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
