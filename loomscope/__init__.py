"""loomscope: evaluation scoring and dataset curation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors with the tasks that use them; it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
