"""glyphtide: a PySpark engine for text-recognition event streams and text corpora.

Functions that run inside Python workers are shipped by value, so executors
need no copy of this package on their own import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
