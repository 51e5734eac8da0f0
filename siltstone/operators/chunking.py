"""Passages with provenance: abstracts, paragraphs, and sliding windows that end at a boundary."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import approx_tokens

SIZE, OVERLAP, STUB = 2048, 512, 30
# Sentence ends a window may end at, by priority.
BOUNDARIES = (". ", "? ", "! ", "\n")


def paragraphs(text: Column, separator: str = "\n\n", least: int = STUB) -> Column:
    """array<struct<paragraph_index, text>>; stubs are left out but keep their number."""
    numbered = F.transform(F.split(text, separator), lambda p, i: F.struct(i.alias("paragraph_index"), F.btrim(p).alias("text")))
    return F.filter(numbered, lambda p: F.length(p["text"]) >= least)


def fixed_windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<struct<start, text>> at every ``size - overlap`` characters until a window reaches the end."""
    last = F.greatest(F.ceil((F.length(text) - size) / (size - overlap)), F.lit(0))
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct((i * (size - overlap)).alias("start"), F.substring(text, (i * (size - overlap) + 1).cast("int"), F.lit(size)).alias("text")))


class _Ends:
    """Where windows of a text may end: for each kind of boundary, the sorted places behind it."""

    def __init__(self, text: str) -> None:
        self.kinds = [(len(mark), np.array([m.end() for m in re.finditer(re.escape(mark), text)])) for mark in BOUNDARIES]

    def between(self, low: int, high: int) -> int:
        """The last place up to ``high`` whose boundary begins at ``low`` or later, of the best kind that has one; else ``high``."""
        for size, places in self.kinds:
            k = int(np.searchsorted(places, high, side="right"))
            if k and places[k - 1] >= low + size:
                return int(places[k - 1])
        return high


def _cut(text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    ends, spans = _Ends(text), [(0, 0)]
    while spans[-1][1] < len(text):
        begin = max(spans[-1][1] - overlap, spans[-1][0] + 1) if len(spans) > 1 else 0
        reach = begin + size
        spans.append((begin, len(text) if reach >= len(text) else ends.between(begin + (size - overlap) // 2, reach)))
    stripped = ((a, b, text[a:b].strip()) for a, b in spans[1:])
    return [piece for piece in stripped if piece[2]]


def snapped_windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<struct<start, end, text>>: each window ends at the last boundary of the best kind in its later part.

    Texts are trimmed, offsets are not; blank windows are left out.  Where a window begins depends on where the one before
    ended, so the recurrence runs in Arrow batches.
    """

    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("start", "end", "text"), w, strict=True)) for w in _cut(t or "", size, overlap)])

    return cut(text)


def chunk_rows(docs: DataFrame, id_col: str, text_col: str, windows: Column) -> DataFrame:
    """(``id_col``, chunk_index, start_char, end_char, chunk_text, token_count), numbered from 0 in each document."""
    cut = docs.select(id_col, F.posexplode(windows).alias("chunk_index", "w"))
    end = F.col("w.start") + F.length("w.text")
    return cut.select(id_col, "chunk_index", F.col("w.start").alias("start_char"), end.alias("end_char"), F.col("w.text").alias("chunk_text"), approx_tokens(F.col("w.text")).alias("token_count"))


def append_chunks(existing: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """``existing`` and the chunks that are not there yet, numbered on from each document's last index; running it again adds nothing."""
    fresh = new.join(existing.select(id_col, "chunk_text"), [id_col, "chunk_text"], "left_anti")
    last = existing.groupBy(id_col).agg(F.max("chunk_index").alias("last"))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("chunk_index"))
    numbered = fresh.withColumn("place", place).join(last, id_col, "left")
    numbered = numbered.withColumn("chunk_index", (F.coalesce("last", F.lit(-1)) + F.col("place")).cast("int"))
    return existing.unionByName(numbered.select(existing.columns))
