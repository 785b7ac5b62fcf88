"""Noisy log text: repeated blocks, stack traces, inline images, long lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.regex import java
from turnloom.functions.text import est_tokens_log, savings_pct, saved_tokens, shorten_long_lines, strip_images
from turnloom.functions.vocab import LABEL

MAX_BLOCK = 5
STACK_KEEP = 3
MODEL_WORDS = 400
OUTPUT_CHARS = 4000
_JS_SPACE = " \t\n\r\v\f ﻿                　"


def _copies(lines: list[str], i: int, size: int) -> int:
    """How often the block of ``size`` lines at i is repeated right after itself; blank blocks do not count."""
    block = lines[i : i + size]
    if len(block) < size or not any(line.strip(_JS_SPACE) for line in block):
        return 0
    n, j = 0, i + size
    while lines[j : j + size] == block:
        n, j = n + 1, j + size
    return n


def fold_repeats(lines: list[str], label: str) -> list[str]:
    """Blocks of one to five lines with at least two copies behind them become one block and a marker."""
    out, i = [], 0
    while i < len(lines):
        for size in range(1, MAX_BLOCK + 1):
            n = _copies(lines, i, size)
            if n > 1:
                out += lines[i : i + size] + [f"... [{n} IDENTICAL BLOCKS COMPRESSED BY {label}] ..."]
                i += size * (n + 1)
                break
        else:
            out.append(lines[i])
            i += 1
    return out


def is_stack_line(line: str) -> bool:
    return line.strip(_JS_SPACE).startswith("at ") or any(s in line for s in ("Traceback ", "node_modules", 'File "'))


def fold_stacks(lines: list[str], label: str) -> list[str]:
    """Runs of more than six stack lines keep their first and last three."""
    out, run = [], []
    for line in [*lines, None]:
        if line is not None and is_stack_line(line):
            run.append(line)
            continue
        if len(run) > 2 * STACK_KEEP:
            marker = f"... [{len(run) - 2 * STACK_KEEP} STACK TRACE LINES COMPRESSED BY {label}] ..."
            run = [*run[:STACK_KEEP], marker, *run[-STACK_KEEP:]]
        out += run
        run = []
        if line is not None:
            out.append(line)
    return out


def _foldable() -> Column:
    """Whether folding can change a text at all: a repeated line, or more than six stack lines."""
    lines = F.split("text", "\n", -1)
    stack = F.filter(
        lines,
        lambda s: s.contains("at ") | s.contains("Traceback ") | s.contains("node_modules") | s.contains('File "'),
    )
    return (F.size(F.array_distinct(lines)) < F.size(lines)) | (F.size(stack) > 2 * STACK_KEEP)


def compact_logs(docs: DataFrame, text: str = "text", label: str = LABEL) -> DataFrame:
    """Add ``compacted``. Only texts where folding can apply go through Python; the rest stays native."""
    rows = docs.withColumnRenamed(text, "text") if text != "text" else docs
    flagged = rows.withColumn("_fold", _foldable())

    @F.pandas_udf("string")
    def folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(
                lambda t: t if t is None else "\n".join(fold_stacks(fold_repeats(t.split("\n"), label), label))
            )

    # the text goes to Python as null unless folding can change it
    candidate = F.when(F.col("_fold"), F.col("text"))
    done = flagged.withColumn("_folded", folded(candidate))
    result = F.coalesce("_folded", "text")
    out = done.withColumn("compacted", shorten_long_lines(strip_images(result))).drop("_fold", "_folded")
    return out.withColumnRenamed("text", text) if text != "text" else out


def line_runs(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Runs of equal consecutive lines per document: first line number, text, length, copies after the first."""
    lines = docs.select(id_col, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    w = Window.partitionBy(id_col).orderBy("line_no")
    change = F.coalesce((F.lag("line").over(w) != F.col("line")), F.lit(True)).cast("long")
    numbered = lines.withColumn("change", change).withColumn("run", F.sum("change").over(w))
    return numbered.groupBy(id_col, "run").agg(
        F.min("line_no").alias("first_line"), F.first("line").alias("line"), F.count(F.lit(1)).alias("n_lines")
    ).select(id_col, "run", "first_line", "line", "n_lines")


def stack_runs(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Runs of stack-trace lines per document."""
    lines = docs.select(id_col, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    stack = (
        F.col("line").rlike(java(r"\A\s*at "))
        | F.col("line").contains("Traceback ")
        | F.col("line").contains("node_modules")
        | F.col("line").contains('File "')
    )
    only = lines.filter(stack)
    w = Window.partitionBy(id_col).orderBy("line_no")
    only = only.withColumn("run", F.col("line_no") - F.row_number().over(w))
    return only.groupBy(id_col, "run").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines")).select(
        id_col, "first_line", "n_lines"
    )


def digest_logs(docs: DataFrame, summary_col: str | None = None, label: str = LABEL) -> DataFrame:
    """Compacted text, then the model summary for short ones, else the first 4000 characters; with token statistics."""
    rows = compact_logs(docs, label=label)
    short = F.size(F.split("compacted", " ", -1)) < MODEL_WORDS
    head = F.substring("compacted", 1, OUTPUT_CHARS)
    body = head if summary_col is None else F.when(short, F.coalesce(F.col(summary_col), head)).otherwise(head)
    rows = rows.withColumn("digest", body)
    original, compressed = est_tokens_log(F.col("text")), est_tokens_log(F.col("digest"))
    return rows.withColumns(
        {
            "original_tokens": original,
            "compressed_tokens": compressed,
            "saved_tokens": saved_tokens(original, compressed),
            "savings_pct": savings_pct(original, compressed, 0),
        }
    )
