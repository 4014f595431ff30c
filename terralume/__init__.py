"""Land-data analytics as Spark table operators.

``functions`` are Column builders, ``operators`` take and return DataFrames,
``plans`` compose operators into whole jobs, ``streaming`` holds the stateful
jobs, and ``queries`` binds every operator to the driver tables.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so executors
# need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
