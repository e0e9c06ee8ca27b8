"""Corpus preparation, versioned libraries, retrieval, citation provenance and trace
analytics as Spark DataFrame and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel with the job, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
