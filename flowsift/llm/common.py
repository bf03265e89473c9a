"""What the operators of this subpackage share: scratch tables, row removal, free column names and id folds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys that are broadcast at most; beyond it the same join is shuffled.
BROADCAST_ROWS = 500_000

_written: list[tuple[SparkSession, str]] = []
_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one for local sessions; on a cluster that is an error."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="flowsift-")
        atexit.register(shutil.rmtree, _own_folder, True)
    return f"file://{_own_folder}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: it cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def marked() -> int:
    """How many scratch tables there are, for discard_stored()."""
    return len(_written)


def discard_stored(since: int = 0, keep_last: bool = False) -> None:
    """Deletes the scratch tables written since a mark (but the last one, with keep_last); frames that still read them become unusable."""
    end = max(since, len(_written) - keep_last)
    gone = _written[since:end]
    del _written[since:end]
    for spark, path in reversed(gone):
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session is over
            return


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores before them until no column has them."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def quoted(columns: list[str]) -> list[str]:
    return [f"`{c.replace('`', '``')}`" for c in columns]


def fold(id_col: str = "doc_id", buckets: int = 5):
    """crc32 of the id as text, modulo buckets; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % buckets


def without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows whose key is not in keys, nulls equal to nulls. keys is broadcast up to BROADCAST_ROWS."""
    named = keys.select(*[F.col(c).alias(f"__k_{c}") for c in on]).distinct()
    named = stored(named, "keys")
    if named.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    cond = [rows[c].eqNullSafe(named[f"__k_{c}"]) for c in on]
    return rows.join(named, cond, "left_anti")


def within(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows whose key is in keys, nulls equal to nulls; sized as without()."""
    named = keys.select(*[F.col(c).alias(f"__k_{c}") for c in on]).distinct()
    named = stored(named, "keys")
    if named.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    cond = [rows[c].eqNullSafe(named[f"__k_{c}"]) for c in on]
    return rows.join(named, cond, "left_semi")
