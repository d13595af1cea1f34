"""Session settings the operators rely on, and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every plan assumes.  Timestamps are UTC throughout; a
# duplicate JSON key keeps the last value (as Python's json.loads does).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows that a Python worker holds at a time: texts may be long
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session (idempotent)."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the session was started.

    Functions that run in workers are pickled by module name.  Unless the
    package's folder is on ``PYTHONPATH`` (or the package is installed), its
    sources are sent to the workers as a zip file, once per application.
    """
    app = spark.sparkContext.applicationId
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(here)
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or root in on_path or "site-packages" in here:
        return
    _shipped.add(app)
    path = os.path.join(tempfile.mkdtemp(prefix="offerlake-py-"), "offerlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)


def get_session(master: str | None = None, app: str = "offerlake",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    On a cluster leave ``master`` unset and let the launcher decide; tests and
    the bench pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(RUNTIME_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    # checkpoint files of intermediates are removed once their plans are gone
    conf["spark.cleaner.referenceTracking.cleanCheckpoints"] = "true"
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = os.environ.get("OFFERLAKE_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when a local session names none (tests) is a private folder created
    and registered; on a cluster it must be named, as executors share nothing else.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # a core setting cannot be changed at runtime, so the context's checkpoint dir carries it
        root = tempfile.mkdtemp(prefix="offerlake-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    root = checkpoint_root(spark).rstrip("/")
    if "://" not in root:
        os.makedirs(root, exist_ok=True)
    return f"{root}/offerlake/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Cut lineage by a reliable checkpoint into the shared checkpoint folder.

    Used for narrow, small intermediates (page keys, per-run stops) that
    several branches of a plan read: the plan then starts from a stored leaf
    instead of repeating the upstream work in every branch.  Reliable
    checkpoints survive executor loss (never ``localCheckpoint``)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


_scopes: list[list[str]] = []


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder, in whatever file system it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Tables that are ``saved`` within the block are removed at its end.

    What leaves the block must be computed by then: a value on the driver, or
    a table saved with ``keep``, which belongs to the block around this one."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete_path(spark, path)


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read from there: computed once, and not again when an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    owners = _scopes[:-1] if keep else _scopes
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
