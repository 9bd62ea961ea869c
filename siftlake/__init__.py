"""siftlake: deduplicating ingest and catalogue analytics as PySpark jobs."""

import sys

from pyspark import cloudpickle

# functions that tasks run travel with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
