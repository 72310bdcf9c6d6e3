"""A PySpark-native analytics engine for intrusion-detection rule corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value: a cluster need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
