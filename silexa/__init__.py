"""silexa: a PySpark-native analytics engine (statistics, text, rules, graphs, models, evaluation)."""
import sys

from pyspark.cloudpickle import register_pickle_by_value

# Python workers need not have this package installed: its functions travel by value.
register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
