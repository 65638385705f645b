"""Operators for preparing text as training data, one module each.

Functions that run in Python tasks travel with the task by value, so executors need no copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
