"""Document-evidence analytics on PySpark: plain DataFrame -> DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with their tasks; nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
