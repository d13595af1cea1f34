"""offerlake: incremental job-posting ingest on Spark DataFrames.

Landed listing and detail responses (JSON text in tables) are turned into a
deduplicated, partitioned store of postings.  Every operator is a column
function (``functions``) or a ``DataFrame -> DataFrame`` function
(``operators``); ``plans`` composes them into whole runs, ``sources`` holds
readers, sinks and the derived test fixtures, ``streaming`` the incremental job.
"""

from offerlake.session import configure, get_session, materialize, scratch_path

__all__ = ["configure", "get_session", "materialize", "scratch_path"]
