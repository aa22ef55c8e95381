"""Training-data operators: filters, deduplication, extraction and mixing.

Nothing else in the library imports this subpackage.
"""
from pyspark import cloudpickle as _cp
import lakeledger as _pkg

# Functions of this package travel to Python workers by value, so executors
# need numpy and pyarrow but no copy of the package itself.
_cp.register_pickle_by_value(_pkg)
