"""Operators for training-data corpora. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of these modules travel to executors with the plan, so that the
# package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
