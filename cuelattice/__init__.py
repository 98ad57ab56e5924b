"""Cuelattice: media-production analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Row kernels travel inside the job, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
