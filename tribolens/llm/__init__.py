"""Training-data operators over the text tables. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this package travel by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
