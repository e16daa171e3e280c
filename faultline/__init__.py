"""faultline: crash-log triage and fix retrieval over commit histories, on Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions sent to executors carry their code, so workers need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
