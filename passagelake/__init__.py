"""passagelake: passages, vectors and retrieval as plain Spark DataFrames.

Functions shipped to Python workers are pickled by value, so a job needs no
``--py-files`` and works from any working directory.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
