"""hazardlake: survival (time-to-event) analytics as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, so that workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
