"""Training-data operators: PII, dedup, classifiers, rules, sharding, mixing, chat.

Nothing else in the library imports this subpackage. Column names of
inputs that begin with an underscore are reserved for the operators. Functions
that run inside Spark tasks are shipped by value, so executors need no copy of
the repository.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
