"""strataforge: archive-to-table analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so that a worker needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
