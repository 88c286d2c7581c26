"""Larkspur: a columnar analytics engine expressed in PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions shipped to Python workers travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
