"""Sensor and alarm analytics expressed as PySpark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Tasks receive the Python kernels together with the plan, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
