"""Operators for training-data corpora. Nothing else in the library imports this subpackage.

Functions that run in tasks are sent with their code, so executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
