"""Files with names and texts of their own, such as the metadata of exported samples.

Spark names the files that it writes itself. Here a task writes its rows' texts, each
under a name of its own and then moved to the one asked for, so a name never stands for
half a text, and a task that is run again puts the same file in the same place. The
folder is complete when ``_SUCCESS`` lies in it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

import scorelane

# Our functions travel with the plan, so executors need not have this package.
register_pickle_by_value(scorelane)


def _folder(path: str):
    """The file system that ``path`` names, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", path))


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, folder = _folder(self.path)
        system.create_dir(folder, recursive=True)
        for row in rows:
            if not row.name or "/" in row.name or row.name[0] in "._":
                raise ValueError(f"{row.name!r} is no name for a file")
            own = f"{folder}/_{uuid.uuid4().hex}"
            with system.open_output_stream(own) as stream:
                stream.write((row.text or "").encode())
            system.move(own, f"{folder}/{row.name}")
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        system, folder = _folder(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        """Finished files stay, as a second run puts the same ones there; half-written ones go."""
        from pyarrow import fs

        system, folder = _folder(self.path)
        held = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        for file in held:
            if re.fullmatch("_[0-9a-f]{32}", file.base_name):
                system.delete_file(file.path)


class NamedTexts(DataSource):
    """Rows of ``name`` and ``text``, a file each."""

    @classmethod
    def name(cls) -> str:
        return "named_texts"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_named_texts(rows: DataFrame, path: str, name: Column | str, text: Column | str) -> None:
    """Write each row's ``text`` to the file ``name`` in the folder ``path``.

    ``path`` is a folder that pyarrow can write to from the executors. Names are unique;
    of equal ones one text stays.
    """
    rows.sparkSession.dataSource.register(NamedTexts)
    name, text = (F.col(x) if isinstance(x, str) else x for x in (name, text))
    files = rows.select(name.alias("name"), text.alias("text"))
    files.write.format("named_texts").mode("append").save(path)
