"""curbflow: trip-record analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: its few Python functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
