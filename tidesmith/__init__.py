"""Relationship discovery between time series, and text curation, as Spark plans."""

import sys

from pyspark import cloudpickle

# functions of this package travel to executors by value, so a cluster needs no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
