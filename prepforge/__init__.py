"""Data preparation and pipeline search on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to workers carry their code with them: executors need not be able to import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
