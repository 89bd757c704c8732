"""Training-data operators. Nothing outside this subpackage imports it; `queries` holds what the driver runs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
