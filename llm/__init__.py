"""Operators of a training-data pipeline, and their registered queries."""

import sys

from pyspark import cloudpickle

# executors need not have the repository: functions of this package travel with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])
