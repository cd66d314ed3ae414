"""plumbline: benchmark-validity analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need not have the package installed: functions of it travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
