"""Entity-by-time panel analytics as plain Spark DataFrame functions.

Every operator takes its frames and column names as arguments and returns a
DataFrame, so Catalyst plans the whole job.  Sub-packages: ``sources`` (ingest,
fixtures, sinks), ``functions`` (column expressions), ``operators`` (frame to
frame), ``plans`` (registered queries with their SQL oracles) and ``streaming``.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
