"""urbanframe: lazily evaluated PySpark operators for city-style batch analytics.

Every public operator takes DataFrames and returns a DataFrame; nothing inside an
operator collects rows to the driver.  Sub-packages:

* ``sources``   readers (CSV with per-file header checks, Parquet, GeoJSON, text) and sinks
* ``functions`` scalar Column expressions (ANSI-safe casts, buckets, money, Haversine)
* ``operators`` relational building blocks (share of total, top-k, argmin, joins,
                exact nearest-site search, lower median, run-log parsing)
* ``plans``     the four composite queries and plan inspection helpers
"""

from urbanframe.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
