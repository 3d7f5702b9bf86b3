"""innsight: hotel-group revenue, occupancy and workload analytics on Spark.

Every public function takes and returns ``DataFrame`` objects; nothing is
collected to the driver.  Tables are passed around as ``dict[str, DataFrame]``
keyed by the table names of :mod:`innsight.sources.schemas`.
"""

from innsight.session import build_session, staging_dir

__all__ = ["build_session", "staging_dir"]
