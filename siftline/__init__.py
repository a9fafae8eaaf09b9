"""siftline: screen large tables and streams of short text posts with Spark.

``posts -> verdicts -> matches``: every step is a DataFrame operator, so the
same code serves a batch sweep over history and a live stream.
"""

import sys

from pyspark import cloudpickle

# Functions handed to mapInPandas travel to the executors by value, so the
# workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
