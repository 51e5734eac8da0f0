"""Fill-in-middle transformation by a two-pass streaming matcher.

A text is a sequence of *units*, the matches of a regular expression from left to right.  The first pass advances a lazy
match iterator to its end and only counts; from the count n and the row's hashes follow two ranks.  The second pass
advances a fresh iterator to the smaller rank, then on to the larger one, and keeps two offsets.  No match is kept,
so working memory beside the text itself is the same for every text.

The hashes are the first four 8-digit groups of the SHA-256 of ``<seed>:<id>``, so a rerun, a retry or another
partitioning cuts every text at the same places.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from itertools import islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Any code point is a unit.
CODE_POINT = r"(?s:.)"
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def _matches(unit: re.Pattern, text: str) -> Iterator[re.Match]:
    """Units, one at a time; empty matches are none."""
    return filter(itemgetter(0), unit.finditer(text))


def count_units(unit: re.Pattern, text: str) -> int:
    """First pass: the number of units; only the last match is alive."""
    last = deque(zip(_matches(unit, text), range(1, len(text) + 1)), maxlen=1)
    return last[0][1] if last else 0


def cut_at(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the unit of rank ``low`` ends, and that of rank ``high`` (both from 1; rank 0 ends at 0)."""
    found = _matches(unit, text)
    first = next(islice(found, low - 1, low)).end() if low else 0
    if high == low:
        return first, first
    return first, next(islice(found, high - low - 1, high - low)).end()


def check_marks(marks: Sequence[str]) -> None:
    """Marks that a text cannot complete by what stands beside them: a first character occurs only as first one."""
    firsts = {m[:1] for m in marks}
    if len(marks) != 3 or "" in firsts or any(c in firsts for m in marks for c in m[1:]):
        raise ValueError("three non-empty marks are needed, whose first characters occur nowhere else in them")
    if any(a != b and b.startswith(a) for a in marks for b in marks) or len(set(marks)) < 3:
        raise ValueError("no mark may be the beginning of another")


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The exact text, rebuilt from the output and its form alone."""
    p, s, m = (F.lit(x) for x in marks)

    def between(after: Column, before: Column | None) -> Column:
        start = F.instr(output, after) + F.length(after)
        return F.substring(output, start, F.length(output)) if before is None else F.substring(output, start, F.instr(output, before) - start)

    prefix = F.when(form == "psm", between(p, s)).otherwise(between(p, m))
    suffix = F.when(form == "psm", between(s, m)).otherwise(between(s, p))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, between(m, None), suffix))


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, seed: str = "1",
    transformed: int = 90, suffix_first: int = 20, marks: Sequence[str] = MARKS,
) -> DataFrame:
    """One row per input row: ``id_col``, n (units), form, prefix_chars, middle_chars (code points), output.

    Of 100 texts about ``transformed`` are cut, of these ``suffix_first`` in 100 in the order suffix, prefix, middle
    (``spm``), the others in the order prefix, suffix, middle (``psm``).  What stands between two units goes with the
    later one, what stands after the last one with the suffix.  A text that is empty or contains a mark is left
    ``plain``, with null lengths.  Null is the empty text; a null id is hashed as the empty one.  Rows that
    repeat an id have the same hashes, and repeated rows the same output.  Texts are handled whole, at any length.  An
    empty table gives an empty result.  Other columns are not read, so their names are free.
    """
    check_marks(marks)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), digest.alias("digest"))
    for k in range(4):
        rows = rows.withColumn(f"h{k + 1}", F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long"))
    rows = rows.drop("digest")
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains(F.col("text"), F.lit(mark))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= transformed)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")).drop("h3", "h4")
    kept = ["id", "form", "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for batch in batches:
            n, low, high = [], [], []
            for text, h1, h2, form in zip(*(batch.column(c) for c in ("text", "h1", "h2", "form")), strict=True):
                text = text.as_py()
                n.append(count_units(pattern, text))
                if form.as_py() == "plain":
                    ends = (None, None)
                else:
                    ranks = sorted(h.as_py() % (n[-1] + 1) for h in (h1, h2))
                    ends = cut_at(pattern, text, *ranks)
                low.append(ends[0])
                high.append(ends[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x, pa.int64()) for x in (n, low, high))], names=[*kept, "n", "low", "high"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    cuts = rows.mapInArrow(cut, f"{schema}, n long, low long, high long")
    text, low, high = F.col("text"), F.col("low"), F.col("high")
    prefix, middle = F.substring(text, F.lit(1), low), F.substring(text, low + 1, high - low)
    suffix = F.substring(text, high + 1, F.length(text))
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)
    return cuts.select(F.col("id").alias(id_col), "n", "form", low.alias("prefix_chars"), (high - low).alias("middle_chars"), output.alias("output"))
