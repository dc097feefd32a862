"""loomlog: session-log analytics and corpus preparation expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

# Ship this package's functions with the tasks that use them, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
