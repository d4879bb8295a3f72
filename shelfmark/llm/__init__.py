"""Operators of a training-data pipeline.

Tasks carry the functions of this package with them, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
