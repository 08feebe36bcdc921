"""What the operators share: reading tables, cutting lineage, naming internal columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WS = "\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a regular expression class body that Java, RE2 and Python read alike.
WS_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store that Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a new one where it is unset and all executors are this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="recordlens-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Folders that ``cut`` wrote and that may still be there, in the order they were made.
_MADE: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    The lineage ends there, what stands above is computed once, and the loss of an executor costs
    only the tasks that it was running.
    """
    at = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _MADE.append(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def made_so_far() -> int:
    """How many tables were cut; for ``drop_cuts``."""
    return len(_MADE)


def drop_cuts(spark: SparkSession, since: int, last: int = 1) -> None:
    """Delete the tables cut ``since`` then, but for the ``last`` ones: what was made on the way to those."""
    gone = _MADE[since : len(_MADE) - last]
    for at in gone:
        _delete(spark, at)
    del _MADE[since : len(_MADE) - last]


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote and that nothing reads any more."""
    root = shared_dir(df.sparkSession)
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cut-" in parent and parent.split(":")[-1].lstrip("/").startswith(root.split(":")[-1].lstrip("/")):
            _delete(df.sparkSession, parent)


def hash_bound(share: float) -> int | None:
    """The signed 64-bit hashes under this number are about ``share`` of all; None: every one."""
    return None if share >= 1 else int(share * 2.0**64) - (1 << 63)


def chosen(share: float, *columns: str):
    """Whether a row is of the ``share`` picked by the 64-bit hash of ``columns``; right for any number of rows."""
    bound = hash_bound(share)
    return F.lit(True) if bound is None else F.xxhash64(*columns) < F.lit(bound).cast("long")


def let(value, body):
    """Bind ``value`` once for the expression ``body(value)``.

    A plain reference inside a lambda is inlined by the optimiser and computed for every element;
    a lambda's own variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
