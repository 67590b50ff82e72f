"""Dataset augmentation and evaluation analytics written directly against the Spark DataFrame API."""

import sys

from pyspark import cloudpickle

# Functions for Spark's Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
