"""Millrace: a DataFrame-first analytics and data-mining library on PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so an executor needs no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
