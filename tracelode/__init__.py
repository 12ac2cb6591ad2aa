"""tracelode: agent-session trace analytics expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Arrow helpers travel to the executors by value, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
