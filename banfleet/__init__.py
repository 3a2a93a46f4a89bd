"""Ban-log and blocklist analytics for fleets of servers, built on PySpark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "1.0.0"

# Functions that run in Python workers travel with their tasks, so that executors
# need numpy, pandas and pyarrow, but not this package.
register_pickle_by_value(sys.modules[__name__])
