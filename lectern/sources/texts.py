"""A text file per row, in folders by the value of a column."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.epub_source import located

# As Spark names the folder of no value, and the characters that it escapes in the others.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def write_texts(df: DataFrame, path: str, by: str, text: str = "text") -> None:
    """Each row's text and a line feed as a file of its own, ``<by>=<value>/part-<task>-<row>.txt``.

    Spark's writer sets rights by a process of its own for each local file, so the tasks write through pyarrow,
    and through Spark only to stores that pyarrow does not know. A task that runs again writes the same names.
    """
    try:
        located(path)
    except (pa.ArrowException, OSError):
        df.select(by, text).write.partitionBy(by).option("maxRecordsPerFile", 1).text(path)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root, _ = located(path)
        task, n, made = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            for value, content in zip(*batch.columns):
                value = value.as_py()
                if value not in made:
                    name = _ESCAPED.sub(lambda x: f"%{ord(x[0]):02X}", value) if value else NO_VALUE
                    made[value] = f"{root}/{by}={name}"
                    system.create_dir(made[value], recursive=True)
                with system.open_output_stream(f"{made[value]}/part-{task:05d}-{n:07d}.txt", buffer_size=0) as file:
                    file.write((content.as_py() or b"") + b"\n")
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["files"])

    df.select(F.col(by).cast("string"), F.col(text).cast("binary")).mapInArrow(run, "files bigint").write.format(
        "noop").mode("overwrite").save()
