"""tidemark: record quality, incremental windows and text checks as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with the job, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
