"""Operators of a training-data pipeline; nothing else in the library imports this package."""

from pyspark import cloudpickle

import cueflow

# Functions sent to tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(cueflow)
