"""meibo: prosopography analytics as composable PySpark DataFrame operators."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Python stages carry their code with them, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
