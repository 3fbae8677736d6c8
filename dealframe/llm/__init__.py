"""Training-data operators. Nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so no executor needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
