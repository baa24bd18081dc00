"""Files of Python data sources: where they lie, and writers that show all parts at once or none."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def store_of(path: str):
    """(file system, path on it) of a path or URI, for use in Python tasks."""
    from pyarrow import fs

    if re.match(r"\w+://", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub("^s3a://", "s3://", path))
    return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)


def files_below(path: str, suffix: str) -> list[str]:
    """The file itself, or the files of a folder with this ending; hidden ones do not count."""
    from pyarrow import fs

    store, at = store_of(path)
    if store.get_file_info(at).type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=False))
    names = sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith((".", "_", "~")))
    return [f"{path.rstrip('/')}/{n}" for n in names]


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class PartWriter(DataSourceWriter):
    """Each task writes a part below a folder of the job; the commit moves the parts in place and adds ``_SUCCESS``.

    An aborted job removes its folder. Overwriting deletes the old parts only after the new ones are in place. Of an empty table
    one task leaves a part without rows, which holds the names.
    """

    suffix = ""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.kinds, self.names, self.overwrite = schema, schema.names, overwrite
        self.path, self.job = options["path"].rstrip("/"), f"_job-{uuid.uuid4().hex}"

    def begin(self) -> PartWriter:
        """Make the job's folder; tasks don't, so one that outlives an abort has nowhere to write."""
        store, at = store_of(f"{self.path}/{self.job}")
        store.create_dir(at, recursive=True)
        return self

    def write_files(self, rows: Iterator) -> Iterator:
        """The rows of each file of a part; one file by default."""
        yield rows

    def write_part(self, out, rows) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        first, part, names = next(iterator, None), TaskContext.get().partitionId(), []
        if first is None and part:
            return Written([])
        store, at = store_of(f"{self.path}/{self.job}")
        for rows in self.write_files(chain([] if first is None else [first], iterator)):
            names.append(f"part-{part:05d}-{uuid.uuid4().hex}{self.suffix}")
            with store.open_output_stream(f"{at}/{names[-1]}", compression=None) as out:
                self.write_part(out, rows)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = store_of(self.path)
        old = [store_of(f)[1] for f in files_below(self.path, self.suffix)] if self.overwrite else []
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{at}/{self.job}/{name}", f"{at}/{name}")
        for f in old:
            store.delete_file(f)
        with store.open_output_stream(f"{at}/_SUCCESS"):
            pass
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, at = store_of(f"{self.path}/{self.job}")
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)
