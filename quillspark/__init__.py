"""Relational operators, table rewrites, constraint checks and double-entry reports as Spark plans."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions that run there travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
