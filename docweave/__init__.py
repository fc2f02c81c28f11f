"""docweave: document knowledge-graph analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need no installed copy: functions of this package travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
