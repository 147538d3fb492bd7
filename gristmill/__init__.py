"""Corpus preparation and training-log analysis as plain PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python helpers travel to the executors inside the job, so no executor needs the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
