"""Files written whole or not at all: a sink for rows of (name, content).

Tasks write under a folder of their job inside the target, which readers that skip names with a
leading underscore don't see. Commit moves each file to its name, one atomic rename each; abort
removes all, and tasks that still run then fail. A rerun replaces files by name. Of attempts of one task only the
committed one counts, as each writes under a name of its own.

A job may carry a fence: a number that grows with each holder of a lock. A commit with a number below
the highest that the target has seen is refused, so that a writer that lost its lock can't overwrite its
successor.

The target is a folder that driver and executors share.

Defined cases: a null content writes nothing; a name that leaves the target, or that two rows of a job
have, fails the job, and nothing is moved; an empty job moves nothing.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

PENDING = "_pending-"
FENCE = "_fence"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weftline_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        made = FileWriter(self.options["path"].removeprefix("file://").removeprefix("file:"), self.options["job"], self.options.get("fence"))
        os.makedirs(made.pending, exist_ok=True)
        return made


class FileWriter(DataSourceWriter):
    def __init__(self, target: str, job: str, fence: str | None):
        self.target, self.pending, self.fence = target, os.path.join(target, PENDING + job), None if fence is None else int(fence)

    def write(self, rows: Iterator[Row]) -> Written:
        folder, files = os.path.join(self.pending, uuid.uuid4().hex), []
        os.mkdir(folder)  # fails once the job has ended
        for row in rows:
            name = row["name"]
            if os.path.isabs(name) or os.path.normpath(name).startswith(("..", "_")) or name != os.path.normpath(name):
                raise ValueError(f"not a name inside the target: {name!r}")
            if row["content"] is not None:
                path = os.path.join(folder, str(len(files)))
                with open(path, "wb") as f:
                    f.write(row["content"])
                    f.flush()
                    os.fsync(f.fileno())
                files.append((path, name))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [x for m in messages if m is not None for x in m.files]
        try:
            names = [name for _, name in files]
            if twice := sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []:
                raise ValueError(f"several rows for {twice[:5]}")
            self._hold()
            for path, name in files:
                final = os.path.join(self.target, name)
                os.makedirs(os.path.dirname(final), exist_ok=True)
                os.replace(path, final)
        finally:
            self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Moves the job's folder first, so that tasks that still run can't write under its name."""
        gone = self.pending + "-ended"
        with contextlib.suppress(FileNotFoundError):
            os.rename(self.pending, gone)
        shutil.rmtree(gone, ignore_errors=True)

    def _hold(self) -> None:
        if self.fence is None:
            return
        path = os.path.join(self.target, FENCE)
        seen = int(open(path).read()) if os.path.exists(path) else -1  # noqa: SIM115
        if self.fence < seen:
            raise PermissionError(f"a writer with fence {seen} came after {self.fence}")
        with open(f"{path}-{uuid.uuid4().hex}", "w") as f:
            f.write(str(self.fence))
        os.replace(f.name, path)


def write_files(rows: DataFrame, target: str, fence: int | None = None) -> None:
    """Writes (name, content) into `target`: all files or none of a task that failed."""
    rows.sparkSession.dataSource.register(FileSink)
    options = {"path": target, "job": uuid.uuid4().hex} | ({} if fence is None else {"fence": str(fence)})
    rows.select("name", "content").write.format(FileSink.name()).options(**options).mode("append").save()
