"""Reading tables, running Python on batches of texts, storing intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.operators.durable import ensure_checkpoint_dir, stored

__all__ = ["ensure_checkpoint_dir", "fields", "map_batches", "map_texts", "stored", "table"]

#: Bytes of text that one call of a batch function gets at most, unless one text is longer.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Maps Arrow batches to column dicts; ``make()`` runs once per task.

    ``make()`` returns a function from an iterator of record batches to an iterator of
    dicts (column name to list or array).
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in make()(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[field.name], type=field.type) for field in arrow], schema=arrow
            )

    return df.mapInArrow(run, schema)


def fields(df: DataFrame, names: tuple[str, ...]) -> str:
    """What the named columns add to a schema text."""
    return "".join(f", {name} {df.schema[name].dataType.simpleString()}" for name in names)


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have SLICE_BYTES together, or of one row."""
    sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(
    df: DataFrame, make: Callable, schema: str, text: str = "text", key: str = "doc_id",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Maps (keys, texts) to column dicts; ``make()`` runs once per task; a null text is empty.

    The columns in ``carry`` go along unchanged; then the function must give a row per text.
    """

    def over() -> Callable:
        function = make()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                for part in slices(batch, text):
                    texts = [value or "" for value in part.column(text).to_pylist()]
                    found = function(part.column(key).to_pylist(), texts)
                    yield found | {name: part.column(name) for name in carry}

        return run

    return map_batches(df.select(key, text, *carry), over, schema + fields(df, carry))
