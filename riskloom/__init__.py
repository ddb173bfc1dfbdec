"""riskloom: transaction-risk analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
