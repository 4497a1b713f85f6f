"""CSV whose quoted fields hold line ends, read by many tasks a file.

A line begins a record if the number of quotes before it in its file is even.  A first
pass counts the quotes of each block of a file; a second one, knowing for each block
whether it begins inside a quoted field, puts the lines of a record together again.
Only records that reach over the edge of a block are joined across tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorewright.session import materialise

WHOLE, HEAD, TAIL = 0, 1, 2
_PART = "file string, block long, kind int, text string"


class _Block:
    """The lines of one block on their way to records."""

    def __init__(self, file: str, block: int, inside: bool, header: bool):
        self.file, self.block, self.inside = file, block, inside
        self.open: list[str] = []
        # Lines before the first record of the block belong to one before it.
        self.head = inside
        self.skip = header and block == 0

    def take(self, lines: list[str], quotes: np.ndarray) -> list[tuple]:
        before = (np.cumsum(quotes) - quotes + self.inside) % 2
        starts = np.flatnonzero(before == 0)
        self.inside = bool((self.inside + quotes.sum()) % 2)
        out: list[tuple] = []
        at = 0
        for start in starts.tolist():
            self.open += lines[at:start]
            out += self.close()
            at = start
            self.head = False
        self.open += lines[at:]
        return out

    def close(self, last: bool = False) -> list[tuple]:
        if not self.open:
            return []
        text, self.open = "\n".join(self.open), []
        if self.head:
            return [(self.file, self.block, HEAD, text)]
        if self.skip:
            self.skip = False
            return []
        return [(self.file, self.block, TAIL if last and self.inside else WHOLE, text)]


def _parts(lines: DataFrame, header: bool) -> DataFrame:
    """Records, and the ends of blocks that are parts of one: its head or its tail."""

    def run(batches):
        now = None
        for batch in batches:
            columns = [batch.column(i) for i in range(3)]
            values = batch.column(3)
            quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64)
            file, block, inside = (c.to_pylist() for c in columns)
            texts = values.to_pylist()
            edges = [0, *(i for i in range(1, len(texts)) if (file[i], block[i]) != (file[i - 1], block[i - 1]))]
            out = []
            for a, b in zip(edges, [*edges[1:], len(texts)]):
                if a == b:
                    continue
                if now is None or (now.file, now.block) != (file[a], block[a]):
                    out += now.close(True) if now else []
                    now = _Block(file[a], block[a], inside[a], header)
                out += now.take(texts[a:b], quotes[a:b])
            yield _batch(out)
        if now:
            yield _batch(now.close(True))

    return lines.mapInArrow(run, _PART)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int32(), pa.string())
    names = ("file", "block", "kind", "text")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def read_quoted_csv(
    spark: SparkSession, path: str, schema: StructType, header: bool = True, **options: str
) -> DataFrame:
    """The records of all files under ``path``, columns by place, as Spark's CSV reader gives them.

    Quotes are written double inside a quoted field, and stand nowhere else.  A quoted
    field without its second quote ends with its file; blank lines are left out, a
    carriage return before the line end of a record is dropped.  What is
    broadcast is one short row for each block of a file that begins inside a field.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    blocks = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = blocks.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    odd = materialise(odd.filter("inside").select("file", "block", "inside"), "blocks")
    # A broadcast join leaves the lines of a block in their order.
    known = lines.join(F.broadcast(odd), ["file", "block"], "left")
    known = known.select("file", "block", F.coalesce("inside", F.lit(False)).alias("inside"), "value")
    parts = _parts(known, header)
    edges = materialise(parts.filter(F.col("kind") != WHOLE), "edges")
    order = Window.partitionBy("file").orderBy("block", "kind")
    begun = edges.withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    pieces = F.sort_array(F.collect_list(F.struct("block", "kind", "text")))
    joined = begun.groupBy("file", "record").agg(pieces.alias("pieces"))
    joined = joined.select(F.array_join(F.col("pieces.text"), "\n").alias("text"))
    records = parts.filter(F.col("kind") == WHOLE).select("text").unionByName(joined)
    text = F.regexp_replace("text", r"\r$", "")
    records = records.select(text.alias("text")).filter("text <> ''")
    form = {"quote": '"', "escape": '"', "multiLine": "true", **options}
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return records.select(F.from_csv("text", columns, form).alias("r")).select("r.*")
