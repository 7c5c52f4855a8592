"""Stream over landed Parquet files in micro-batches of at most so many records.

An offset is a number of records in the order in which files were first seen. That order, with the records of each file (from
its footer), is kept in a log beside the job's checkpoint, so that a restarted job counts as before. A micro-batch ends at most
`max_records` after the last one that was planned: the end that Spark has noted is the only one to go on from. Files are listed
by the driver, records are read by the tasks, each from its own part of a file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from loglathe import fixed

TASK_RECORDS = 100_000  # records that one task of a micro-batch reads


class _Part(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.most = int(options["max_records"])
        self.schema = to_arrow_schema(schema)
        self.system, self.path = _place(options["path"])
        self.log_system, self.log = _place(options["log"])
        self.log_system.create_dir(self.log, recursive=True)
        self.files = [x for n in self._numbers("files-") for x in self._read(f"files-{n}")]  # [path, records]
        planned = self._numbers("planned-")
        self.planned = planned[-1] if planned else 0

    def _numbers(self, kind: str) -> list[int]:
        names = [x.base_name for x in self.log_system.get_file_info(fs.FileSelector(self.log))]
        return sorted(int(n.removeprefix(kind)) for n in names if n.startswith(kind))

    def _read(self, name: str):
        with self.log_system.open_input_stream(f"{self.log}/{name}") as f:
            return json.loads(f.read())

    def _write(self, name: str, value) -> None:
        """A file of the log appears whole or not at all."""
        with self.log_system.open_output_stream(f"{self.log}/.{name}") as f:
            f.write(json.dumps(value).encode())
        self.log_system.move(f"{self.log}/.{name}", f"{self.log}/{name}")

    def _look(self, enough: int) -> None:
        """Note new files, oldest first, until there are enough records."""
        total = sum(n for _, n in self.files)
        if total >= enough:
            return
        known = {path for path, _ in self.files}
        there = self.system.get_file_info(fs.FileSelector(self.path, recursive=True, allow_not_found=True))
        new = [x for x in there if x.is_file and x.base_name.endswith(".parquet") and x.base_name[0] not in "._" and x.path not in known]
        found = []
        for x in sorted(new, key=lambda x: (x.mtime_ns, x.path)):
            if "/_temporary/" in x.path:
                continue
            with self.system.open_input_file(x.path) as f:
                found.append([x.path, pq.ParquetFile(f).metadata.num_rows])
            total += found[-1][1]
            if total >= enough:
                break
        if found:
            self._write(f"files-{len(self.files)}", found)
            self.files += found

    def initialOffset(self) -> dict:
        return {"records": 0}

    def latestOffset(self) -> dict:
        self._look(self.planned + self.most)
        return {"records": min(sum(n for _, n in self.files), self.planned + self.most)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = start["records"], end["records"]
        if high > self.planned:
            self._write(f"planned-{high}", high)
            self.planned = high
        parts, at = [], 0
        for path, n in self.files:
            first, last = max(low, at), min(high, at + n)
            for k in range(first, last, TASK_RECORDS):
                parts.append(_Part(path, k - at, min(TASK_RECORDS, last - k)))
            at += n
        return parts

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        skip, left = partition.first, partition.count
        with self.system.open_input_file(partition.path) as f:
            file = pq.ParquetFile(f)
            for group in range(file.num_row_groups):
                rows = file.metadata.row_group(group).num_rows
                if skip >= rows:
                    skip -= rows
                    continue
                for batch in file.iter_batches(row_groups=[group], columns=self.schema.names):
                    if skip >= batch.num_rows:
                        skip -= batch.num_rows
                        continue
                    part = batch.slice(skip, left)
                    skip, left = 0, left - part.num_rows
                    yield from pa.Table.from_batches([part]).select(self.schema.names).cast(self.schema).to_batches()
                    if not left:
                        return

    def commit(self, end: dict) -> None:
        """Older notes of what was planned are of no use any more."""
        for n in self._numbers("planned-"):
            if n < end["records"]:
                self.log_system.delete_file(f"{self.log}/planned-{n}")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


class RecordSource(DataSource):
    """Options: path, log, max_records."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options, schema)


def bounded(spark: SparkSession, path: str, log: str, schema: StructType | str, max_records: int = fixed.WORKER_BATCH) -> DataFrame:
    """Stream of the records below `path`; `log` belongs to one job, as its checkpoint does.

    Give the job a processing-time trigger and stop it when it is drained: ``availableNow`` takes one micro-batch only.
    """
    spark.dataSource.register(RecordSource)
    reader = spark.readStream.format("records").schema(schema)
    return reader.option("path", path).option("log", log).option("max_records", max_records).load()


def consumed(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> int:
    """Records taken up to the end of a micro-batch; without a number, of the last one that the job has committed."""
    if batch_id is None:
        names = spark.read.text(f"{checkpoint}/commits").select(F.regexp_extract("_metadata.file_name", r"^(\d+)$", 1).alias("n"))
        batch_id = names.where("n <> ''").agg(F.max(F.col("n").cast("int"))).first()[0]
        if batch_id is None:
            return 0
    offset = F.get_json_object("value", "$.records").cast("bigint")
    return spark.read.text(f"{checkpoint}/offsets/{batch_id}").agg(F.max(offset)).first()[0] or 0


def depth(spark: SparkSession, path: str, checkpoint: str, batch_id: int | None = None) -> int:
    """Records that have landed and are not consumed yet."""
    return spark.read.parquet(path).count() - consumed(spark, checkpoint, batch_id)
