"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts (type, text, ref, units). The visitor turns
each part into text: a text part is its own text; an image, audio or document part
becomes a numbered placeholder, its reference goes to the attachment list in order,
and its expanded token count is ``units`` (tiles, seconds, pages) times the type's
tokens a unit. Unknown types are treated as documents.

Template of a turn: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside roles and texts
``~`` is written ``~0``, ``<|`` is written ``~1`` and, in roles, a newline ``~2``:
no control string can come from content, and the way back is exact. Placeholders are
written as ``~3KIND:N~4`` after escaping, so content cannot forge them either.

``read_chats`` gives the texts as written and, apart, each turn's parts: a placeholder is
told from a text that looks like one, and gets its reference back.

The loss mask is the array of code-point ranges of assistant texts. Positions come
from a running sum over a conversation's turns. A formatted conversation is one
string, so its turns meet in one row; that is the result asked for, and a
conversation is as long as its own text.

Null text and role are empty; turns that tie are ordered by role, then text;
repeated rows are turns of their own; a null conv_id is a conversation. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens a unit of each type stands for: an image tile, an audio second, a document page.
EXPANSION = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("~1"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("~2"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("~2"), F.lit("\n")))


def as_parts(text: Column) -> Column:
    """A plain text as one typed part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def visit(parts: Column) -> Column:
    """struct(body, attachments, tokens) of an array of parts, in their order."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    kind = lambda p: F.when(F.coalesce(p["type"], F.lit("text")).isin("text", *EXPANSION), F.coalesce(p["type"], F.lit("text"))).otherwise("document")
    typed = F.transform(parts, lambda p: F.struct(kind(p).alias("kind"), F.coalesce(p["text"], F.lit("")).alias("text"), p["ref"].alias("ref"), F.coalesce(p["units"], F.lit(1)).alias("units")))
    files = F.filter(typed, lambda p: p["kind"] != "text")
    rate = lambda k: F.coalesce(*(F.when(k == t, n) for t, n in EXPANSION.items()))
    # The number of a placeholder is its place among the parts, kept with the reference.
    body = F.transform(typed, lambda p, i: F.when(p["kind"] == "text", escape(p["text"])).otherwise(F.concat(F.lit("~3"), p["kind"], F.lit(":"), i.cast("string"), F.lit("~4"))))
    placed = F.filter(F.transform(typed, lambda p, i: F.struct(i.cast("bigint").alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), (p["units"] * rate(p["kind"])).alias("tokens"))), lambda a: a["kind"] != "text")
    tokens = F.aggregate(files, F.lit(0).cast("bigint"), lambda a, p: a + p["units"] * rate(p["kind"]))
    return F.struct(F.array_join(body, "").alias("body"), placed.alias("attachments"), tokens.alias("tokens"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans, attachments, attachment_tokens.

    turns: conv_id, turn, role and either ``parts`` or ``text``.
    """
    parts = F.col("parts") if "parts" in turns.columns else as_parts(F.col("text"))
    seen = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visit(parts).alias("v"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    made = seen.select("conv_id", "turn", "role", F.col("v.body").alias("body"), "v.attachments", "v.tokens", F.concat(head, "v.body", F.lit(END + "\n")).alias("segment"), F.length(head).cast("bigint").alias("head"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = made.withColumn("no", F.row_number().over(order)).withColumn("at", F.coalesce(F.sum(F.length("segment").cast("bigint")).over(upto), F.lit(0)) + F.col("head"))
    span = F.when(F.col("role") == loss_role, F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    row = F.struct("no", "segment", span.alias("span"), F.transform("attachments", lambda a: F.struct(F.col("no").alias("turn_no"), a["place"].alias("place"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("files"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.sum("tokens").alias("attachment_tokens"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["segment"]), "").alias("formatted"),
        F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("rows", lambda r: r["files"])).alias("attachments"),
        "attachment_tokens",
    )


def parts_of(body: Column, files: Column) -> Column:
    """The parts (type, text, ref) that a written body was made of, neighbouring texts as one.

    Placeholders are told apart while control marks are still escaped, so a text that
    looks like one stays a text. files: the attachments of the turn, which hold references.
    """
    ref = lambda place: F.try_element_at(F.transform(F.filter(files, lambda f: f["place"] == place), lambda f: f["ref"]), F.lit(1))
    text = lambda t: F.struct(F.lit("text").alias("type"), unescape(t).alias("text"), F.lit(None).cast("string").alias("ref"))

    def placeholder(mark: Column) -> Column:
        place = F.substring_index(mark, ":", -1).cast("bigint")
        return F.struct(F.substring_index(mark, ":", 1).alias("type"), F.lit("").alias("text"), ref(place).alias("ref"))

    def cut(piece: Column, i: Column) -> Column:
        tail = F.when(i == 0, piece).otherwise(F.substring(piece, F.instr(piece, "~4") + 2, F.length(piece)))
        mark = F.when(i > 0, F.array(placeholder(F.substring_index(piece, "~4", 1)))).otherwise(F.slice(F.array(text(piece)), 1, 0))
        return F.concat(mark, F.when(tail != "", F.array(text(tail))).otherwise(F.slice(F.array(text(tail)), 1, 0)))

    return F.flatten(F.transform(F.split(body, "~3"), cut))


def read_chats(formatted: DataFrame) -> DataFrame:
    """The turns (role, text with placeholders, parts) and the loss texts, from formatted strings."""
    cut = F.split("formatted", r"\Q" + START + r"\E")
    segments = F.slice(cut, F.lit(2), F.size(cut))
    body = lambda s: F.substring(s, F.lit(1), F.length(s) - len(END) - 1)
    written = lambda s: F.substring(body(s), F.instr(s, "\n") + 1, F.length(s))
    files = lambda i: F.filter("attachments", lambda f: f["turn_no"] == i + 1) if "attachments" in formatted.columns else F.lit(None).cast("array<struct<place:bigint,ref:string>>")
    parts = F.transform(segments, lambda s, i: parts_of(written(s), files(i)))
    pairs = F.transform(segments, lambda s: F.struct(unescape_role(F.substring_index(s, "\n", 1)).alias("role"), unescape(written(s)).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", pairs.alias("turns"), loss.alias("loss_texts"), parts.alias("parts"))


def report(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what is read back."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read_chats(formatted).select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))
