"""Curation and evaluation analytics for labelled image collections, as Spark plans."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Functions of this package travel with the plan, so executors need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
