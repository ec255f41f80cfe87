"""Lodestone: evidence analytics expressed as Spark DataFrame plans."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions handed to Python workers travel by value, so that executors need
# nothing but PySpark and the public libraries the functions import.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
