"""Operators of a training-data pipeline. Nothing outside this package and its tests imports it."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
