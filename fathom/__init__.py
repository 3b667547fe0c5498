"""Fathom: multi-vector memory and retrieval analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their task, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
