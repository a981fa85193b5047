"""Plans that go on in rounds: tables written between them, so that lineage stays short and a lost executor costs one round."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; where that is unset, in one of our own that goes at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="quillspark-")
            atexit.register(shutil.rmtree, _own["dir"], True)
        base = f"file://{_own['dir']}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "round") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    at = shared_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
