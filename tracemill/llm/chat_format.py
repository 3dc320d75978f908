"""Chat formatting with typed content parts (DataFrame functions only).

A visitor turns every part of a turn into text: text parts are escaped, image, audio and document
parts become a placeholder, an attachment record and a count of the tokens that the placeholder
expands to. Turns are framed as ``<|im_start|>role\\nbody<|im_end|>\\n``.

Escaping is reversible and leaves no control string inside a text: ``<!`` gains one more ``!``, then
``<|`` becomes ``<!|``; in role names a line break becomes ``<!n``. Between two text parts stands ``<!,``, which no
escaped text holds, so no control string can form across parts and each part is unescaped by itself. Parts of other types than text, image,
audio and document get the placeholder ``<|part:type|>``, so no type can pass for a control string.

Defined results: null texts, roles and part lists are empty; an empty table gives an empty result;
turns are ordered by (turn, role, body), nulls first, so repeated rows are kept and ties cannot
change the output; a null conversation id is a conversation of its own; other columns are ignored.
One conversation is one output row, so its whole text must fit in a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What stands between two text parts that follow each other.
JOINT = "<!,"
#: Attachments with a placeholder of their own.
KNOWN = ("image", "audio", "document")
#: Pixels a side of one image patch, audio milliseconds a token, tokens a document page.
PATCH, MS_PER_TOKEN, PAGE_TOKENS = 14, 40, 256
PARTS_TYPE = "array<struct<type:string,text:string,ref:string,width:long,height:long,duration_ms:long,pages:long>>"


def _replace(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def escape(c: Column) -> Column:
    return _replace(_replace(c, "<!", "<!!"), "<|", "<!|")


def unescape(c: Column) -> Column:
    return _replace(_replace(c, "<!|", "<|"), "<!!", "<!")


def unescape_body(c: Column) -> Column:
    """Text parts are unescaped one by one: what they end and begin with must not be taken together."""
    return F.array_join(F.transform(F.split(c, r"\Q" + JOINT + r"\E", -1), unescape), "")


def escape_role(c: Column) -> Column:
    return _replace(escape(c), "\n", "<!n")


def unescape_role(c: Column) -> Column:
    return unescape(_replace(c, "<!n", "\n"))


def text_part(text: Column) -> Column:
    """A part list holding one text."""
    null = {k: F.lit(None).cast("long").alias(k) for k in ("width", "height", "duration_ms", "pages")}
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), *null.values())).cast(PARTS_TYPE)


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def placeholder(kind: Column) -> Column:
    """``<|kind|>``; kinds beyond KNOWN, which may be named like a control string, become ``<|part:kind|>``, escaped."""
    own = F.when(kind.isin(*KNOWN), kind).otherwise(F.concat(F.lit("part:"), _replace(escape(kind), "|>", "!|>")))
    return F.concat(F.lit("<|"), own, F.lit("|>"))


def visit(part: Column) -> Column:
    """The string that stands for a part. Types not known are attachments of their own name."""
    return F.when(is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(placeholder(part["type"]))


def expanded_tokens(part: Column) -> Column:
    """How many tokens a model spends on an attachment; 0 for text."""
    n = lambda k: F.coalesce(part[k], F.lit(0))
    return (
        F.when(part["type"] == "image", F.ceil(n("width") / PATCH) * F.ceil(n("height") / PATCH))
        .when(part["type"] == "audio", F.ceil(n("duration_ms") / MS_PER_TOKEN))
        .when(part["type"] == "document", n("pages") * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def format_chat(turns: DataFrame, conv="conv_id", turn="turn", role="role", parts="parts", loss_role="assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (spans of trained text), attachments.

    ``loss``: array of (turn_index, start, length), code points within the body of that turn.
    ``attachments``: array of (turn_index, part_index, type, ref, tokens), in order.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(parts), F.array().cast(PARTS_TYPE)).cast(PARTS_TYPE).alias("parts"),
    )
    follows = lambda i: (i > 0) & is_text(F.get("parts", i)) & is_text(F.get("parts", i - 1))
    joint = lambda i: F.when(follows(i), F.lit(JOINT)).otherwise(F.lit(""))
    rows = rows.withColumn("pieces", F.transform("parts", lambda p, i: F.concat(joint(i), visit(p)))).withColumn("body", F.array_join("pieces", ""))
    rows = rows.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumn("turn_index", (F.row_number().over(order) - 1).cast("int"))
    before = lambda i: F.aggregate(F.slice("pieces", 1, i), F.lit(0), lambda a, x: a + F.char_length(x))
    spans = F.filter(
        F.transform("parts", lambda p, i: F.when(is_text(p), F.struct(F.col("turn_index"), (before(i) + F.char_length(joint(i))).alias("start"), F.char_length(visit(p)).alias("length")))),
        lambda s: s.isNotNull() & (s["length"] > 0),
    )
    rows = rows.withColumn("spans", F.when(F.col("role") == loss_role, spans).otherwise(F.array().cast("array<struct<turn_index:int,start:int,length:int>>")))
    seen = F.filter(
        F.transform(
            "parts",
            lambda p, i: F.when(
                ~is_text(p),
                F.struct(F.col("turn_index"), i.alias("part_index"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    rows = rows.select("conv_id", "turn_index", F.concat("head", "body", F.lit(END + "\n")).alias("framed"), "spans", seen.alias("seen"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn_index", "framed", "spans", "seen"))).alias("all"))
    return whole.select(
        "conv_id",
        F.array_join("all.framed", "").alias("formatted"),
        F.flatten("all.spans").alias("loss"),
        F.flatten("all.seen").alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` again: adds turns (array of role, body, text) and loss_texts, both unescaped."""

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        skip = F.char_length(role) + 1
        body = F.substring(x, skip + 1, F.char_length(x) - skip - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), body.alias("body"), unescape_body(body).alias("text"))

    framed = F.split("formatted", r"\Q" + START + r"\E", -1)
    out = formatted.withColumn("turns", F.transform(F.slice(framed, 2, F.greatest(F.size(framed) - 1, F.lit(0))), turn))
    under = lambda s: unescape(F.substring(F.element_at("turns", s["turn_index"] + 1)["body"], s["start"] + 1, s["length"]))
    return out.withColumn("loss_texts", F.transform("loss", under))


def digests(parsed: DataFrame) -> DataFrame:
    """The digest columns of the conversations that read_back() found."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return parsed.withColumn("loss_text", F.array_join("loss_texts", "")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
