"""Operators for large text corpora, one module each, and their registered queries.

Functions of this package that run inside tasks travel by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
