"""A PySpark-native engine for evaluation analytics and training-data audits."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Workers need not have this package on their path: its functions travel by value.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
