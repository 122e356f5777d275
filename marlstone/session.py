"""Session helpers: a tuned local session, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of values up to which the small side of a join is broadcast; beyond either the join shuffles.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def get_session(app: str = "marlstone", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass your own session to the operators."""
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the checkpoint folder already set.

    Only where neither is set and there is one machine (tests in local mode) a temporary one is
    made, one for the application, and removed when the driver ends.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="marlstone-")
        atexit.register(shutil.rmtree, _own[sc.applicationId], True)
    return _own[sc.applicationId]


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in ``shared_folder``, so that lost executors cost no recomputation."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``max_rows`` rows and ``max_bytes`` bytes of values, else leave the choice to Catalyst.

    Both are measured in one aggregate; ``df`` should be cheap to read (a checkpoint or a small table).
    """
    wide = [F.octet_length(F.col(f"`{c}`").cast("string")) for c, kind in df.dtypes if kind in ("string", "binary") or kind.startswith(("array", "struct", "map"))]
    fixed = F.lit(8 * (len(df.columns) - len(wide)))
    n, size = df.agg(F.count("*"), F.sum(sum((F.coalesce(w, F.lit(0)) for w in wide), fixed).cast("long"))).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df
