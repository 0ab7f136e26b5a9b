"""tyscope: Spark-native analytics over Python type annotations.

Sub-packages
------------
sources    file / JSON / stand-in table readers and writers
functions  native column functions (base type, dates, truncation, paths)
operators  extraction job and the relational operators (reports, ranking,
           name counts, triage)
plans      query registry and the DuckDB oracle text for each query
streaming  incremental (micro-batch) extraction of a growing source tree
"""

from tyscope.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
