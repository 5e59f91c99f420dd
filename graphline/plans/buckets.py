"""Tables that keep their rows dealt by a key, so that joins on it don't deal them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from graphline.plans.iterate import shared_folder


def bucketed(df: DataFrame, *keys: str, dealt: bool = False) -> DataFrame:
    """``df`` written to the shared folder, in as many buckets of the keys as shuffles have partitions, and read again.

    A loop that joins it with something else in every round shuffles the other side
    alone. ``dealt`` says that ``df`` comes from a join or an aggregation by the keys
    and needs no shuffle of its own. The table's name is known to the session only;
    its files stay for the cluster's own clean-up.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"graphline_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/graphline/{name}"
    rows = df if dealt else df.repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)
