"""Operators for preparing training data, built as Spark jobs.

Functions that run in Python workers are sent by value, so that executors need numpy and pyarrow
but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
