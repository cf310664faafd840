"""The log of a model's replies: one file per request, committed when the reply is there."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.commits import write_units

REPLIES = "batch_id bigint, ids array<string>, reply string, at bigint"


def write_replies(requests: DataFrame, folder: str, reply: Callable[[str], str] | None) -> None:
    """Commit the reply to every request (batch_id, ids, prompt) as soon as it is there.

    Without ``reply`` the requests hold their replies. A call that raises is logged as a null
    reply; only an interrupted process leaves a request out.
    """

    def produce(batch_id, rows) -> bytes:
        row = next(iter(rows))
        if reply is None:
            text = row["reply"]
        else:
            try:
                text = reply(row["prompt"])
            except Exception:  # noqa: BLE001 - any provider failure is a missing reply
                text = None
        line = {"batch_id": batch_id, "ids": list(row["ids"]), "reply": text,
                "at": time.time_ns()}
        return json.dumps(line).encode() + b"\n"

    write_units(requests.repartition("batch_id"), folder, "batch_id", produce, ".json")


def new_run(folder: str) -> str:
    """Where the requests of one pass go: batch numbers start again in each."""
    return f"{folder}/run={uuid.uuid4().hex}"


def read_replies(spark: SparkSession, folder: str) -> DataFrame:
    """(batch_id, ids, reply, at, run) of all committed requests; none without a log.

    For the folder of one run there is no column ``run``.
    """
    try:
        return spark.read.schema(REPLIES).json(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{REPLIES}, run string")


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """As :func:`read_replies`, with batch ids that tell the runs apart."""
    return read_replies(spark, folder).withColumn(
        "batch_id", F.concat_ws("/", "run", F.col("batch_id").cast("string"))
    )
