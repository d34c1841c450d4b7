"""Retail shelf analytics expressed as Spark DataFrame, SQL and streaming jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
