"""A PySpark-native analytics engine for timestamped, segmented data."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
