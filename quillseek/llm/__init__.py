"""Corpus preparation for language-model training. Nothing else in the package imports this folder."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors whole, so that these need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
