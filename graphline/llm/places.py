"""The place of each row in the files it is read from."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphline.llm.common import stored

#: Rows of a block.
ROWS = 1 << 14
#: Plans whose rows are the same at every pass: a scan of files, its columns and conditions.
PLAIN = ("Relation", "Project", "Filter", "SubqueryAlias")


def _is_scan(docs: DataFrame) -> bool:
    jdf = getattr(docs, "_jdf", None)
    if jdf is None or "_metadata" in docs.columns:
        return False
    plan = jdf.queryExecution().analyzed()
    lines = [line.lstrip(" :+-") for line in plan.toString().split("\n") if line.strip()]
    return plan.deterministic() and all(line.startswith(PLAIN) for line in lines)


def placed(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as in_0, in_1, ..., with ``block`` and ``row`` (long): where each row stands.

    A scan of files is used as it is, anything else is written to the shared folder first.
    """
    plain = [F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(docs.columns)]
    number = F.col("_metadata.row_index")
    place = [F.xxhash64(F.col("_metadata.file_path"), F.floor(number / ROWS)).alias("block"), number.alias("row")]
    if _is_scan(docs):
        try:
            return docs.select(*plain, *place)
        except AnalysisException:  # a source that doesn't tell the rows of its files
            pass
    return stored(docs.select(*plain), "placed").select("*", *place)
