"""Grounded document retrieval and corpus preparation on Spark DataFrames.

The package ships its Python functions to executors by value, so a cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
