"""Operators for building training data; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Tasks carry the code they need, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
