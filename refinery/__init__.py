"""refinery: a PySpark-native data-curation library.

Every operator is ``DataFrame -> DataFrame`` (plus an optional one-row
report DataFrame), expressed with Spark SQL expressions, joins, windows
and aggregates so Catalyst plans it and it runs distributed.
"""

from refinery.session import build_session, ensure_checkpoint_dir, read_table, register_tables

__all__ = ["build_session", "ensure_checkpoint_dir", "read_table", "register_tables"]
