"""corpusmill: a PySpark-native engine for multilingual public-vote corpora."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to executors by value, so a cluster needs
# no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
