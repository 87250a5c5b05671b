"""Operators for large training corpora. Nothing else in the library imports this subpackage.

Its functions travel to the executors by value, so a cluster's Python workers
need numpy and pyarrow but not this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
