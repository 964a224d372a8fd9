"""Cut a lineage once and reuse the result; survives the loss of executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    The folder is ``spark.checkpoint.dir``. Only a local session may fall back to a temporary one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="serialake-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
