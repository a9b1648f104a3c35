"""Corpuscle: document analytics and hybrid search, written for Spark first.

Functions of this package that run inside Python workers are shipped by value,
so that executors need nothing but PySpark, numpy and pyarrow.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
