"""framelake: search, indexing and evaluation of multimodal video archives as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package by value, so that jobs run whether or not the package is on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
