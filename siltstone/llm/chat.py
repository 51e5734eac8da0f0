"""Chat formatting of typed content parts, by DataFrame functions alone.

A turn's content is an ordered array of parts (kind, text, ref, units).  The visitor turns the parts into text: a run of text
parts is joined and escaped, an image, audio or document part becomes a numbered placeholder, whose reference and expanded
token count are recorded in the order of the placeholders.  Plain texts are cut into parts at media links such as
``![image 2](a.png)``; reading back puts the links in again.  Turns are framed by control strings:

    <s>[TURN]role[TEXT]content[/TURN] ... </s>

Inside roles and texts a control string gets one backslash after its opening bracket, and one that already
has backslashes there gets one more; the reverse takes one away.  Nothing else of a text changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What may stand in brackets in a control string.
_NAMES = r"(?:/?s>|/?TURN\]|TEXT\]|(?:IMAGE|AUDIO|DOCUMENT):[0-9]+\])"
CONTROL = rf"([<\[])(\\*{_NAMES})"
_ESCAPED = rf"([<\[])\\(\\*{_NAMES})"
#: Tokens that one unit of an attachment expands to: image tiles, seconds of audio, document pages.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 640}
PART = "struct<kind:string,text:string,ref:string,units:double>"
#: A media link of a plain text: kind, units (1 if not given) and reference.
MEDIA = r"!\[(?:image|audio|document)(?: [0-9]{1,6})?\]\([^()\s]+\)"
_PLACEHOLDER = r"\[(?:IMAGE|AUDIO|DOCUMENT):[0-9]+\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\$2"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2"))


def text_parts(text: Column) -> Column:
    """The typed parts of a plain text: what stands between its media links, and the links; null is the empty text."""
    plain = F.coalesce(text, F.lit(""))
    between, links = F.split(plain, MEDIA), F.regexp_extract_all(plain, F.lit(MEDIA), F.lit(0))
    bare = lambda t: F.struct(F.lit("text").alias("kind"), t.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"))
    pick = lambda link, group: F.regexp_extract(link, r"^!\[([a-z]+) ?([0-9]*)\]\((.*)\)$", group)
    units = lambda link: F.coalesce(F.nullif(pick(link, 2), F.lit("")).cast("double"), F.lit(1.0))
    media = lambda link: F.struct(pick(link, 1).alias("kind"), link.alias("text"), pick(link, 3).alias("ref"), units(link).alias("units"))
    mixed = F.flatten(F.zip_with(between, links, lambda t, link: F.when(link.isNull(), F.array(bare(t))).otherwise(F.array(bare(t), media(link)))))
    return F.when(F.size(links) == 0, F.array(bare(plain))).otherwise(mixed).cast(f"array<{PART}>")


def _attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*UNIT_TOKENS), F.lit(False))


def _content(parts: str) -> Column:
    """Neighbouring text parts are one text before it is escaped, so that no control string can be pieced together."""
    at = F.filter(F.transform(parts, lambda p, i: F.when(_attachment(p), i)), lambda i: i.isNotNull())
    ends = F.concat(F.array(F.lit(-1)), at, F.array(F.size(parts)))

    def run(end: Column, k: Column) -> Column:
        begin = ends[k] + 1
        text = F.array_join(F.transform(F.slice(parts, begin + 1, end - begin), lambda p: F.coalesce(p["text"], F.lit(""))), "")
        here = F.get(F.col(parts), ends[k])
        place = F.when(k > 0, F.concat(F.lit("["), F.upper(here["kind"]), F.lit(":"), (k - 1).cast("string"), F.lit("]"))).otherwise("")
        return F.concat(place, escape(text))

    return F.array_join(F.transform(F.slice(ends, 2, F.size(ends) - 1), run), "")


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_col``, formatted, loss_spans, attachments, n_attachment_tokens.

    loss_spans are the character ranges [start, end) of the contents of ``loss_role`` turns; attachments has an entry
    (turn, place, kind, ref, tokens, source, loss) for each placeholder, place counting from 0 inside the turn, source being
    the part's text and loss whether it is under the loss mask.  Turns are ordered by ``turn_col``, nulls first, ties by role
    and content.  A conversation is one output row, so its turns meet in one task and its size is bounded by that of a row.  A null role or text is empty; a null or empty array of parts
    is an empty content; a part of unknown kind is read as text; units below 0 or null count as 0.  Repeated rows are
    turns of their own.  Rows of a null conversation form one.  Other columns are not read.
    """
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>")).alias("parts"))
    files = F.filter("parts", _attachment)
    tokens = lambda p: F.ceil(F.greatest(F.coalesce(p["units"], F.lit(0.0)), F.lit(0.0)) * F.create_map(*(F.lit(x) for kv in UNIT_TOKENS.items() for x in kv))[p["kind"]]).cast("long")
    rows = rows.select(
        "conv", "turn", "role",
        _content("parts").alias("content"),
        F.transform(files, lambda p, i: F.struct(i.alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens"), p["text"].alias("source"))).alias("files"),
    )
    head = F.concat(F.lit("[TURN]"), escape("role"), F.lit("[TEXT]"))
    rows = rows.select("conv", "turn", "role", "content", "files", head.alias("head"))
    length = F.length("head") + F.length("content") + F.lit(len("[/TURN]"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "content", F.to_json("files")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(length).over(order), F.lit(0)) + F.lit(len("<s>")) + F.length("head"))
    turns = F.array_sort(F.collect_list(F.struct("start", "turn", "role", "head", "content", "files")))
    chats = rows.groupBy("conv").agg(turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.length(t["content"])).alias("end")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit("[/TURN]"))), "")
    of = lambda t, f: F.struct(t["turn"].alias("turn"), *(f[c].alias(c) for c in ("place", "kind", "ref", "tokens", "source")), (t["role"] == loss_role).alias("loss"))
    files = F.flatten(F.transform("turns", lambda t: F.transform(t["files"], lambda f: of(t, f))))
    return chats.select(F.col("conv").alias(conv_col), F.concat(F.lit("<s>"), joined, F.lit("</s>")).alias("formatted"), spans.alias("loss_spans"), files.alias("attachments")).withColumn(
        "n_attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, f: a + f["tokens"])
    )


def _restored(formatted: Column, attachments: Column) -> Column:
    """The formatted text with the escaped source of each attachment, if it has one, in place of its placeholder."""
    between, places = F.split(formatted, _PLACEHOLDER), F.regexp_extract_all(formatted, F.lit(_PLACEHOLDER), F.lit(0))
    put = F.zip_with(places, attachments, lambda p, a: F.coalesce(escape(a["source"]), p))
    return F.array_join(F.zip_with(between, put, lambda t, p: F.concat(t, F.coalesce(p, F.lit("")))), "")


def read_turns(formatted: Column, attachments: Column | None = None) -> Column:
    """array<struct<role, text>> of a formatted conversation; placeholders stay as they are, or give way to ``attachments``."""
    whole = formatted if attachments is None else _restored(formatted, attachments)
    body = F.substring(whole, F.lit(len("<s>") + 1), F.length(whole) - len("<s></s>"))
    framed = F.filter(F.split(body, r"\[/TURN\]"), lambda t: t != "")
    split = lambda t: F.split(F.substring(t, F.lit(len("[TURN]") + 1), F.length(t)), r"\[TEXT\]")
    return F.transform(framed, lambda t: F.struct(unescape(split(t)[0]).alias("role"), unescape(split(t)[1]).alias("text")))


def read_loss(formatted: Column, spans: Column, attachments: Column | None = None) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between; placeholders as in ``read_turns``."""
    end = "[/TURN]"  # keeps neighbouring spans apart until they are unescaped
    joined = F.array_join(F.transform(spans, lambda s: F.substring(formatted, s["start"] + 1, s["end"] - s["start"])), end)
    if attachments is not None:
        joined = _restored(joined, F.filter(attachments, lambda a: a["loss"]))
    return F.array_join(F.transform(F.split(joined, r"\[/TURN\]"), unescape), "")
