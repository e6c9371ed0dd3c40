"""Spark jobs for news and information feeds, grouped by run so that many runs, days and sources go in one job."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
