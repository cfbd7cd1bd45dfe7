"""Operators for training-data pipelines, and the queries that apply them.

Functions of this package that run in tasks travel with the job, so executors need no
copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
