"""T5: a mail folder as a streaming source whose offset is the high-water mark.

The offset is the newest ``internal_millis`` of a mail whose body is not blank. Spark commits
it with the checkpoint, so a restarted stream goes on behind it and takes each mail once; a
blank mail is never taken and moves nothing. A mail that comes to the folder later than a
newer one was taken lies before the mark and is not taken any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "mail_id long, internal_millis long, body string"
_COLUMNS = ["mail_id", "internal_millis", "body"]


@dataclass
class MailFiles(InputPartition):
    """Files of the folder, and the marks between which mails are read."""

    files: tuple[str, ...]
    after: int
    until: int


class MailReader(DataSourceStreamReader):
    def __init__(self, path: str, since: int, files_per_task: int) -> None:
        self.path, self.since, self.files_per_task = path, since, files_per_task

    def folder(self, files: tuple[str, ...] | None = None) -> ds.Dataset:
        filesystem, path = pa.fs.FileSystem.from_uri(self.path)
        return ds.dataset(list(files) if files else path, format="parquet", filesystem=filesystem, exclude_invalid_files=False)

    @staticmethod
    def newer(after: int, until: int | None = None) -> pc.Expression:
        found = (pc.field("internal_millis") > after) & pc.match_substring_regex(pc.field("body"), r"\S")
        return found if until is None else found & (pc.field("internal_millis") <= until)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"mark": self.since}

    def latestOffset(self, start: dict | None = None, limit: object = None) -> dict:  # noqa: N802
        """The newest mail's time: one column of the files, batch by batch, filtered in the scan."""
        mark = self.since if start is None else start["mark"]
        for batch in self.folder().to_batches(columns=["internal_millis"], filter=self.newer(mark)):
            if batch.num_rows:
                mark = max(mark, pc.max(batch.column(0)).as_py())
        return {"mark": mark}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["mark"] >= end["mark"]:
            return []
        files, n = sorted(self.folder().files), self.files_per_task
        return [MailFiles(tuple(files[k : k + n]), start["mark"], end["mark"]) for k in range(0, len(files), n)]

    def read(self, partition: MailFiles) -> Iterator[pa.RecordBatch]:
        yield from self.folder(partition.files).to_batches(columns=_COLUMNS, filter=self.newer(partition.after, partition.until))

    def commit(self, end: dict) -> None:
        """The mark is in the checkpoint; the folder keeps its files."""


class MailSource(DataSource):
    """``spark.dataSource.register(MailSource)``, then ``spark.readStream.format("mail")``.

    Options: ``path`` is the URI of a folder of Parquet files with the columns of SCHEMA that
    the driver and all executors see; ``since`` the mark that a first run begins behind;
    ``filesPerTask`` how many files a task reads.
    """

    @classmethod
    def name(cls) -> str:
        return "mail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> MailReader:  # noqa: N802
        return MailReader(self.options["path"], int(self.options.get("since", 0)), int(self.options.get("filespertask", 8)))
