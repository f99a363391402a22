"""Code free text against classification catalogues, as Spark jobs."""

import sys

from pyspark import cloudpickle

# The package's functions travel with the tasks, so the workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
