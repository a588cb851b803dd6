"""Covert-channel analytics over DNS and ICMP packet tables, written as Spark jobs."""

import sys

from pyspark import cloudpickle

# Ship the package's own functions inside each task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
