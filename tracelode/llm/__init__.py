"""Operators of a training-data pipeline: filtering, deduplication, scanning, scoring, encoding and packing."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel with the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
