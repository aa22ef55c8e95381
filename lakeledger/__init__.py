"""A PySpark-native transactional table engine over Parquet and a JSON commit log."""
from .functions.schema import common, merge, same
from .operators.table import LakeTable, Mode
from .sources.intake import FileSet, union
from .sources.storage import Location, register_settings, unregister_settings

__all__ = ["FileSet", "LakeTable", "Location", "Mode", "common", "merge", "register_settings", "same", "union", "unregister_settings"]
