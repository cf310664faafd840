"""Writing a table unit by unit, each unit visible as soon as it is done.

A unit is a run of rows with one key: a request to a model, a chunk of texts to encode. Its
file is written under another name and moved into place, so a file that exists is a commit. A
job that dies loses the units its tasks were at; a unit that is there already is not made
again, whether by a repeated task or by a later run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "plumbline_units"


@dataclass
class Done(WriterCommitMessage):
    made: int
    found: int


def file_system(folder: str):
    """(file system, path) of a folder that the executors share."""
    from pyarrow import fs

    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder.removeprefix("file:")


class UnitWriter(DataSourceWriter):
    """Calls ``produce(key, rows)`` for each unit that has no file and moves the bytes there."""

    def __init__(self, folder: str, key: str, produce: Callable, suffix: str):
        self.folder, self.key, self.produce, self.suffix = folder, key, produce, suffix

    def write(self, iterator: Iterator[Row]) -> Done:
        from pyarrow.fs import FileType

        system, root = file_system(self.folder)
        system.create_dir(root, recursive=True)
        done = Done(0, 0)
        for key, rows in groupby(iterator, key=lambda row: row[self.key]):
            target = f"{root}/unit-{key}{self.suffix}"
            if system.get_file_info(target).type != FileType.NotFound:
                done.found += 1
                continue
            content = self.produce(key, rows)
            # Readers pass over names that start like this.
            held = f"{root}/_{uuid.uuid4().hex}"
            with system.open_output_stream(held) as out:
                out.write(content)
            system.move(held, target)
            done.made += 1
        return done

    def commit(self, messages: list) -> None:
        """Counts of the run; units count without it."""
        system, root = file_system(self.folder)
        system.create_dir(root, recursive=True)
        told = [message for message in messages if message is not None]
        counts = {"made": sum(m.made for m in told), "found": sum(m.found for m in told)}
        with system.open_output_stream(f"{root}/_run-{uuid.uuid4().hex}") as out:
            out.write(json.dumps(counts).encode())

    def abort(self, messages: list) -> None:
        """Finished units stay."""


def write_units(
    df: DataFrame, folder: str, key: str, produce: Callable[[object, Iterator[Row]], bytes],
    suffix: str,
) -> None:
    """Write ``df``, in which the rows of a unit follow one another, a file per unit.

    ``produce`` runs in the tasks, once per unit; it may take long and may fail.
    """

    class Units(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def writer(self, schema, overwrite) -> DataSourceWriter:
            return UnitWriter(folder, key, produce, suffix)

    df.sparkSession.dataSource.register(Units)
    df.write.format(FORMAT).mode("append").save()
