"""Tables whose rows are files, (name, value), written and read. A file is there whole or not at all.

Tasks write beside the folder's files, each task into a hidden folder of its own. When all tasks are done, the commit
renames what they wrote into place, over files of the same names; if the job fails, the hidden folder goes.

Very many files are dealt over numbered folders in the folder. They are read by tasks that list some of these
each, so the driver holds no list of files, and no more tasks than a few for each core.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES, BATCH_FILES, TASKS_PER_CORE = 4 << 20, 1000, 4


def open_folder(path: str):
    """(file system, path there) of a folder named by a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def numbered(folder: int) -> str:
    return f"{folder:03}"


def _under(*names: str) -> str:
    return "/".join(n for n in names if n)


@dataclass
class Written:
    folder: str | None
    below: list[str] = field(default_factory=list)  # the numbered folders in it; the empty name for itself


class FilesWriter:
    def __init__(self, path: str, dealt: bool = False):
        self.path, self.pending, self.dealt = path.rstrip("/"), f".pending-{uuid.uuid4().hex}", dealt

    def write(self, iterator: Iterator) -> Written:
        files, base = open_folder(self.path)
        mine = f"{base}/{self.pending}/{uuid.uuid4().hex}"
        made: dict[str, None] = {}
        for row in iterator:
            name, value = row[-2], row[-1]
            if not name or "/" in name:
                raise ValueError(f"not a file name: {name!r}")
            below = numbered(row[0]) if self.dealt else ""
            if below not in made:
                files.create_dir(_under(mine, below))
                made[below] = None
            with files.open_output_stream(_under(mine, below, name)) as out:
                out.write(value.encode() if isinstance(value, str) else bytes(value or b""))
        return Written(mine if made else None, list(made))

    def commit(self, messages: list[Written]) -> None:
        from pyarrow import fs

        files, base = open_folder(self.path)
        files.create_dir(base)
        # what lost attempts of tasks wrote has no message
        for message in messages:
            if message.folder:
                for below in message.below:
                    files.create_dir(_under(base, below))
                    for info in files.get_file_info(fs.FileSelector(_under(message.folder, below))):
                        files.move(info.path, _under(base, below, info.base_name))
        self._drop(files, base)

    def abort(self) -> None:
        self._drop(*open_folder(self.path))

    def _drop(self, files, base: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{base}/{self.pending}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/{self.pending}")


def read_folders(path: str, folders: Iterator[str]) -> Iterator:
    """Batches (name, value) of the text files in ``folders`` below ``path``, of a few MB or one file; a folder that got no file is not there."""
    import pyarrow as pa
    from pyarrow import fs

    files, base = open_folder(path)
    if files.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    names, values, held = [], [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], ["name", "value"])
    for below in folders:
        for info in files.get_file_info(fs.FileSelector(_under(base, below), allow_not_found=True)):
            if not info.is_file:
                continue
            with files.open_input_stream(info.path) as file:
                value = file.read()
            names.append(info.base_name)
            values.append(value.decode())
            held += len(value)
            if held >= BATCH_BYTES or len(names) >= BATCH_FILES:
                yield batch()
                names, values, held = [], [], 0
    if names:
        yield batch()


def write_files(files: DataFrame, path: str, folder: str | None = None) -> None:
    """``files`` (name, value) as files in the folder ``path``; those of other names stay.

    ``folder`` names a column that tells, from 0 on, in which numbered folder in ``path`` a file goes; there may be some thousands of these.
    """
    from ..plans.storage import bounded_batches, bounded_broadcasts

    spark: SparkSession = files.sparkSession
    writer = FilesWriter(path, folder is not None)

    def run(batches):
        import pyarrow as pa

        done = writer.write(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([done.folder], pa.string()), pa.array([done.below], pa.list_(pa.string()))], ["folder", "below"])

    with bounded_batches(spark), bounded_broadcasts(spark):
        try:
            # a row for each task: of several attempts of one, the one that counts
            rows = files.select(*([folder] if folder else []), "name", "value").mapInArrow(run, "folder string, below array<string>").collect()
            writer.commit([Written(*row) for row in rows])
        except BaseException:
            writer.abort()
            raise


def read_files(spark: SparkSession, path: str, folders: int = 0) -> DataFrame:
    """(name, value) of the text files in the folder ``path``, or in its numbered ``folders``; a task lists the folders that it reads, one after another."""
    path = path.rstrip("/")

    def run(batches):
        return read_folders(path, (numbered(k) if folders else "" for batch in batches for k in batch.column("id").to_pylist()))

    n = max(folders, 1)
    tasks = min(n, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return spark.range(0, n, 1, tasks).mapInArrow(run, "name string, value string")
