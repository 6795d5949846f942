"""Text dataset preparation and summary evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# executors get the few Python functions with the job and need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
