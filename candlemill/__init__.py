"""candlemill: chart-pattern research on price tables, written as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The small Arrow helpers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
