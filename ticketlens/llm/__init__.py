"""Operators that prepare training text: dedup, extraction, scoring, packing, sharding."""

import sys

from pyspark import cloudpickle

# Ship the functions of these modules to the workers by value, as the labelling job does:
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
