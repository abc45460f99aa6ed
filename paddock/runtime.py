"""Session helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Catalyst prunes its columns and pushes filters down to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is missing a private folder is made and set on one machine (tests); on a
    cluster that is an error, as executors would not see each other's files.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        now = sc._jsc.sc().getCheckpointDir()
        if now.isDefined():
            return now.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="paddock-")
        sc.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@dataclass
class Cut:
    """A written intermediate table with the numbers observed while it was written."""

    df: DataFrame
    path: str
    seen: dict = field(default_factory=dict)

    def drop(self) -> None:
        """Delete the files; only for tables nothing will read again."""
        _delete(self.df.sparkSession, self.path)


def cut(df: DataFrame, tag: str, **measures: Column) -> Cut:
    """Write ``df`` to the shared folder and read it back, so that later plans start from files.

    A written table survives the loss of executors and, unlike ``checkpoint()``, is made in one
    pass and stays columnar. ``rows`` and any further ``measures`` are counted in that pass.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/paddock/{tag}-{uuid.uuid4().hex[:12]}"
    seen = Observation()
    named = [F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in measures.items())]
    df.observe(seen, *named).write.parquet(path)
    _WRITTEN.append((spark, path))
    return Cut(spark.read.schema(df.schema).parquet(path), path, seen.get)


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """Marks a folder for deletion at exit."""
    _WRITTEN.append((spark, path))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder now."""
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; its folder is the cluster's to empty
            return


def join_sized(big: DataFrame, small: Cut, keys: list[str], salt_by: Column, limit: int = 1_000_000, salts: int = 32) -> DataFrame:
    """Inner join with a written table: broadcast up to ``limit`` rows, beyond it by salted keys.

    The size is that counted when the table was written. Salting splits keys that hold a large
    share of ``big``; the small side is repeated once a salt.
    """
    if small.seen["rows"] <= limit:
        return big.join(F.broadcast(small.df), keys)
    spread = small.df.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("salt_", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).join(spread, [*keys, "salt_"]).drop("salt_")
