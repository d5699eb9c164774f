"""Environment choice: the workspace id in a URL looked up in the env map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantweave.functions import broadcast_if_literal

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results).
WORKSPACE_MARK = "adb-"  # the id is the text after it, up to the next '.'
# ---------------------------------------------------------------------------
STATUS_OK = "ok"
STATUS_NO_ID = "no workspace id in url"
STATUS_UNMAPPED = "workspace not in env map"


def workspace_id(url):
    """Text between the first and second ``adb-`` mark, cut at the first '.'."""
    has = F.instr(url, WORKSPACE_MARK) > 0
    part = F.split_part(url, F.lit(WORKSPACE_MARK), F.lit(2))
    return F.when(has, F.split_part(part, F.lit("."), F.lit(1)))


def resolve_env(urls: DataFrame, env_map: DataFrame, url_col: str = "url") -> DataFrame:
    """Add workspace_id, env and status to every row of ``urls``.

    Rows whose URL has no workspace id, or whose id is not mapped (or maps to
    an empty env), keep a null env and a non-ok status instead of failing the
    whole job.
    """
    m = env_map.select(F.col("workspace_id").alias("_ws"), F.col("env"))
    x = urls.withColumn("workspace_id", workspace_id(F.col(url_col)))
    j = x.join(broadcast_if_literal(m, made_from=env_map), F.col("workspace_id") == F.col("_ws"), "left")
    ok_env = F.col("env").isNotNull() & (F.col("env") != "")
    status = (
        F.when(F.col("workspace_id").isNull(), F.lit(STATUS_NO_ID))
        .when(~ok_env, F.lit(STATUS_UNMAPPED))
        .otherwise(F.lit(STATUS_OK))
    )
    return j.select(*urls.columns, "workspace_id", F.when(ok_env, F.col("env")).alias("env"), status.alias("status"))
