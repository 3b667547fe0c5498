"""Training-data operators: search, deduplication, sharding, quality, tokens and packing."""

import sys

from pyspark import cloudpickle

# Executors get this package's code inside the task, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
