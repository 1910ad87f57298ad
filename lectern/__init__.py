"""Lectern: retrieval analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job, so nothing need be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
