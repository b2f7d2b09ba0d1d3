"""Tables that several jobs change at once: rows by key, in numbered versions.

A change writes its rows into a folder of their own and then puts up the marker of the next version. A marker is
renamed into place and never over another one, so of two jobs that started from the same version one fails to put
up its own; it reads what the other left and works its change out again. A version is whole or not there, and a job
that dies before its marker leaves nothing that is read. Every ``WHOLE_EVERY`` versions a change writes all rows
anew, so that readers look at few folders; :meth:`Table.vacuum` deletes those from before.

The rename is as safe as the file system's: on HDFS and the like it is atomic, on a local disk it is for tests.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import bounded_broadcasts

WHOLE_EVERY = 32


class Conflict(Exception):
    """Other jobs were first every time."""


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()

    def _fs(self):
        return self._jpath(self.path).getFileSystem(self._conf)

    def _marker(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def _names(self, folder: str) -> list[str]:
        at = self._jpath(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs().listStatus(at)] if self._fs().exists(at) else []

    def version(self) -> int:
        """The newest version; -1 where nothing was ever put in."""
        return max((int(n.split(".")[0]) for n in self._names("versions") if n.endswith(".json")), default=-1)

    def _parts(self, version: int) -> list[tuple[int, str]]:
        """(version, folder) of the changes that make up a version, back to the last whole one."""
        out = []
        for v in range(version, -1, -1):
            stream = self._fs().open(self._jpath(self._marker(v)))
            try:
                said = json.loads(bytes(stream.readAllBytes()))
            finally:
                stream.close()
            out.append((v, said["folder"]))
            if said["whole"]:
                break
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        at = self.version() if version is None else version
        rows = self.spark.createDataFrame([], f"{self.schema}, _gone boolean").withColumn("_version", F.lit(0))
        for v, folder in self._parts(at):
            some = self.spark.read.schema(f"{self.schema}, _gone boolean").parquet(f"{self.path}/{folder}")
            rows = rows.unionByName(some.withColumn("_version", F.lit(v)))
        columns = [c for c in rows.columns if c not in ("_gone", "_version")]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct("_gone", *columns), "_version").alias("_row"))
        return newest.filter("not _row._gone").select("_row.*").select(*columns)

    def _put_up(self, version: int, folder: str, whole: bool) -> bool:
        """False where that version is there already."""
        jvm = self.spark._jvm
        held = self._jpath(f"{self.path}/pending/{uuid.uuid4().hex}")
        out = self._fs().create(held)
        out.write(bytearray(json.dumps({"folder": folder, "whole": whole}).encode()))
        out.close()
        marker = self._jpath(self._marker(version))
        self._fs().mkdirs(marker.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._jpath(self.path).toUri(), self._conf)
        try:
            files.rename(held, marker, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self._fs().delete(held, False)
            return False
        return True

    def _write(self, rows: DataFrame) -> str:
        folder = f"rows-{uuid.uuid4().hex}"
        with bounded_broadcasts(self.spark):
            rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def change(self, rows_of: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
        """Put in ``rows_of(the rows held now)``, which may have a column ``_gone``; it is asked again where another job was first.

        A row takes the place of the one with its key; no key may come twice. The new version comes back.
        """
        for _ in range(tries):
            at = self.version()
            held = self.read(at)
            new = rows_of(held)
            new = new.withColumn("_gone", F.coalesce("_gone", F.lit(False)) if "_gone" in new.columns else F.lit(False)).select(*held.columns, "_gone")
            whole = (at + 1) % WHOLE_EVERY == 0 and at >= 0
            if whole:
                new = held.join(new, self.keys, "left_anti").withColumn("_gone", F.lit(False)).unionByName(new.filter("not _gone"))
            folder = self._write(new)
            if self._put_up(at + 1, folder, whole):
                return at + 1
            self._fs().delete(self._jpath(f"{self.path}/{folder}"), True)
        raise Conflict(self.path)

    def put(self, rows: DataFrame) -> int:
        """Rows that do not depend on what the table holds."""
        return self.change(lambda held: rows)

    def remove(self, keys: DataFrame) -> int:
        """``keys``: rows with some or all of the key columns."""
        named = [c for c in self.keys if c in keys.columns]
        return self.change(lambda held: held.join(keys.select(*named).distinct(), named, "left_semi").withColumn("_gone", F.lit(True)))

    def vacuum(self) -> None:
        """Delete the folders that the newest version does not need. No other job may be at work."""
        used = {folder for _, folder in self._parts(self.version())}
        for name in self._names(""):
            if name.startswith("rows-") and name not in used or name == "pending":
                self._fs().delete(self._jpath(f"{self.path}/{name}"), True)
