"""Lines out of a table's text column."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .loglines import decoded, raw_lines

LINE_BYTES, MATCHED_BYTES = 2000, 16_000


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of_text(df: DataFrame, file: str, text: str, *carry: str) -> DataFrame:
    """file, path, number, text: each row's text split at line feeds, one trailing CR gone.

    The last line counts as complete.  A null text has no lines; an empty one has one, empty."""
    rows = df.select(F.col(file).alias("file"), *carry, F.posexplode(F.split(text, "\n", -1)).alias("pos", "text"))
    return rows.select("file", F.col("file").cast("string").alias("path"), *carry, (F.col("pos") + 1).cast("long").alias("number"), F.regexp_replace("text", "\r$", "").alias("text"))


def cut_line(text: Column, most: int = MATCHED_BYTES) -> Column:
    """A line's first ``most`` bytes, broken characters replaced."""
    return F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))


def with_cuts(lines: DataFrame) -> DataFrame:
    """Whether a line is over LINE_BYTES (cut) or over what is matched (still_cut), and its text as far as that."""
    size = F.octet_length("text")
    return lines.withColumns({"cut": size > LINE_BYTES, "still_cut": size > MATCHED_BYTES, "text": F.when(size > MATCHED_BYTES, cut_line(F.col("text"))).otherwise(F.col("text"))})


READ = "file long, number long, text string, cut boolean, still_cut boolean, end_offset long"


def lines_from(df: DataFrame) -> DataFrame:
    """The lines of each row's bytes from its place on, by the rules of the line source: READ columns.

    df: file (long), data (binary), start, number (complete lines before the start).  A null has no lines."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # one text at a time: its lines are a batch
                file, data, start, number = (batch.column(c)[row].as_py() for c in ("file", "data", "start", "number"))
                stream, out = io.BytesIO(data or b""), []
                stream.seek(start)
                for line in raw_lines(stream, start):
                    if not line.only_nuls:
                        out.append((file, number + 1, decoded(line.kept), len(line.kept.removesuffix(b"\r")) > LINE_BYTES, line.left_out, line.end))
                    number += line.ended
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    return df.select("file", "data", "start", "number").mapInArrow(step, READ)
