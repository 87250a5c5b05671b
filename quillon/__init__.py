"""Analytics for comparing language-model outputs, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel to Python workers by value: a cluster's workers need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
