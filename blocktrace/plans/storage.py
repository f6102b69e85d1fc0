"""Where intermediate tables live, and how small tables are joined."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder that is removed
    when the process ends. A cluster without it is refused: a machine-local folder would lose the data together
    with the executor that wrote it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="blocktrace-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """Compute `df` once for several later uses.

    The table is Parquet in the shared folder, which cuts the lineage, survives
    executor loss and keeps column pruning for the readers.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_counted(df: DataFrame, label: str = "table") -> tuple[DataFrame, int]:
    """``settle``, with the number of rows, which is counted while they are written."""
    seen = Observation()
    settled = settle(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return settled.select(*df.columns), int(seen.get["rows"])


#: Plans that cost no more than reading a table again.
SCAN_NODES = {"Project", "Filter", "LogicalRelation", "SubqueryAlias"}


def scanned(df: DataFrame) -> bool:
    """True if `df` is stored rows, filtered or with computed columns, without a join, sort or aggregate."""
    nodes = [df._jdf.queryExecution().analyzed()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() not in SCAN_NODES:
            return False
        below = node.children()
        nodes += [below.apply(i) for i in range(below.size())]
    return True


def counted(df: DataFrame, label: str = "rows") -> tuple[DataFrame, int]:
    """`df` as stored rows and their number; what is stored already isn't written again."""
    return (df, df.count()) if scanned(df) else settle_counted(df, label)


def join_weighted(rows: DataFrame, side: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join with a side of one row per key, whose column `weight` says how many rows have the key.

    A key of more than a thousandth of all weighed rows is hot. There are less
    than a thousand of those, so they are broadcast; the others are shuffled.
    """
    side = settle(side, "side")
    heavy = F.col(weight) * 1000 > (side.agg(F.sum(weight)).first()[0] or 0)
    hot, cold = side.filter(heavy), side.filter(~heavy)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))


def attach(df: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a table that should hold a few rows per trace.

    The side is settled, so Spark knows its size when it plans the join: it is
    broadcast up to ``spark.sql.autoBroadcastJoinThreshold``; beyond that the
    join shuffles, and adaptive execution splits skewed partitions.
    """
    return df.join(settle(side, "side"), on, how)
