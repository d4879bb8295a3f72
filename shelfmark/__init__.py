"""Offer categorisation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Tasks carry the functions of this package with them, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
