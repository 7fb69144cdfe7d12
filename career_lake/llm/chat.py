"""Chat formatting with typed content parts (operator 11), with SQL functions only.

A message has a role and a list of typed parts. A visitor flattens the parts in
order: a text is escaped, an image, an audio clip or a document becomes a
placeholder `<|kind|>`, and leaves an attachment record (its turn, place among
the conversation's attachments, kind, reference, and the tokens that it expands
to). A turn reads `<|im_start|>role newline content <|im_end|> newline`.
`<|part|>` stands between two texts, so that they can be told apart.

Control strings inside texts are escaped by one more `|` after each `<|`, which
read_back takes away again; a text can thus never open or close a turn. Roles are
escaped alike, with `<|n|>` for a line feed.

The loss mask is a list of spans by turn, in code points of the formatted text:
those of the texts of assistant turns, without marks and placeholders.

Turns come in order of turn (nulls first), then of their formatted text;
repeated rows are turns of their own. Null texts, roles and lists of parts
are empty; null parts are left out. A part without kind is a text; a part of another kind
is a placeholder `<|other|>` of no tokens. Rows without conv_id form one
conversation. An empty table gives an empty result. Extra columns of the input
are ignored.

Turns are formatted where they are read; only formatted turns are shuffled, once.
A conversation is one row, as its formatted text is one string.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, BETWEEN, NEWLINE = "<|im_start|>", "<|im_end|>", "<|part|>", "<|n|>"
#: What a part holds.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Pixels of a patch's side (a patch is a token), tokens of a second of audio and of a page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 256
#: Turns whose lengths are added up together.
BLOCK = 256

#: For each kind of attachment, the tokens that its placeholder expands to.
VISITORS: Mapping[str, Callable[[Column], Column]] = {
    "image": lambda p: F.ceil(p["width"] / PATCH) * F.ceil(p["height"] / PATCH),
    "audio": lambda p: F.ceil(p["seconds"] * PER_SECOND),
    "document": lambda p: p["pages"] * PER_PAGE,
}


def escaped(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<||"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def text_parts(text: Column) -> Column:
    """A list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))).cast(f"array<{PART}>")


def _is_text(p: Column) -> Column:
    return F.coalesce(p["kind"] == "text", F.lit(True))


def visited(parts: Column) -> Column:
    """Each part as (mark, body, kind, ref, tokens): what stands before it, its escaped text, and the attachment's record."""
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    before = F.concat(F.array(F.lit(False)), F.transform(parts, _is_text))

    def visit(p: Column, after_text: Column) -> Column:
        kind = F.when(p["kind"].isin(*VISITORS), p["kind"]).otherwise("other")
        tokens = F.lit(0).cast("long")
        for name, expands in VISITORS.items():
            tokens = F.when(p["kind"] == name, F.greatest(F.lit(0).cast("long"), F.coalesce(expands(p).cast("long"), F.lit(0).cast("long")))).otherwise(tokens)
        mark = F.when(~_is_text(p), F.concat(F.lit("<|"), kind, F.lit("|>"))).when(after_text, F.lit(BETWEEN)).otherwise("")
        return F.struct(
            mark.alias("mark"),
            F.when(_is_text(p), escaped(p["text"])).otherwise("").alias("body"),
            F.when(~_is_text(p), p["kind"]).alias("kind"),
            p["ref"].alias("ref"),
            tokens.alias("tokens"),
        )

    return F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), visit)


def _before(x: Column) -> Column:
    """For each element of a list of numbers, the sum of those before it."""
    none = F.struct(F.array().cast("array<long>").alias("out"), F.lit(0).cast("long").alias("total"))
    step = lambda a, v: F.struct(F.concat(a["out"], F.array(a["total"])).alias("out"), (a["total"] + v).alias("total"))
    return F.aggregate(x, none, step, lambda a: a["out"])


def _before_in_blocks(x: Column) -> Column:
    """The same for long lists: sums inside blocks, and sums of blocks."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))
    total = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, v: a + v)
    return F.flatten(F.zip_with(F.transform(blocks, _before), _before(F.transform(blocks, total)), lambda inside, start: F.transform(inside, lambda v: v + start)))


def formatted_turns(messages: DataFrame) -> DataFrame:
    """conv_id, turn, piece (the turn's whole formatted text), loss (its spans inside the piece), attached; messages: conv_id, turn, role, parts."""
    role = F.coalesce(messages["role"].cast("string"), F.lit(""))
    header = F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    out = messages.select("conv_id", "turn", (role == "assistant").alias("learn"), header.alias("header"), visited(messages["parts"]).alias("parts"))
    chars = F.transform("parts", lambda p: (F.length(p["mark"]) + F.length(p["body"])).cast("long"))
    span = lambda p, start: F.struct((start + F.length("header") + F.length(p["mark"])).cast("long").alias("start"), F.length(p["body"]).cast("long").alias("chars"))
    spans = F.filter(F.zip_with("parts", _before(chars), span), lambda s: s["chars"] > 0)
    content = F.array_join(F.transform("parts", lambda p: F.concat(p["mark"], p["body"])), "")
    return out.select(
        "conv_id",
        "turn",
        F.concat("header", content, F.lit(END + "\n")).alias("piece"),
        F.when(F.col("learn"), spans).otherwise(F.slice(spans, 1, 0)).alias("loss"),
        F.transform(F.filter("parts", lambda p: p["kind"].isNotNull()), lambda p: F.struct("turn", p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("attached"),
    )


def formatted_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, turns, attachments, expanded_tokens of each conversation; messages: conv_id, turn, role, parts (PART each).

    turns: each turn's start and length in formatted, and the spans that are learnt (start, chars), in code points.
    """
    turns = formatted_turns(messages).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "piece", "loss", "attached"))).alias("all"))
    starts = _before_in_blocks(F.transform("all", lambda t: F.length(t["piece"]).cast("long")))
    moved = lambda t, start: F.struct(
        start.alias("start"),
        F.length(t["piece"]).cast("long").alias("chars"),
        F.transform(t["loss"], lambda s: F.struct((s["start"] + start).alias("start"), s["chars"].alias("chars"))).alias("loss"),
    )
    attached = F.flatten(F.transform("all", lambda t: t["attached"]))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("formatted"),
        F.zip_with("all", starts, moved).alias("turns"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns_read (role and text of each turn) and loss_text (all text under the mask), from formatted and turns alone.

    Turns are found by their marks. A turn's text is that of its text parts, unescaped, one after the other.
    """
    pieces = F.split("formatted", r"\Q" + START + r"\E", -1)
    out = formatted.withColumn("pieces", F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        content = F.substring(p, F.length(head) + 2, F.length(p) - F.length(head) - 2 - len(END))
        role = unescaped(F.replace(head, F.lit(NEWLINE), F.lit("\n")))
        text = F.array_join(F.transform(F.split(content, r"<\|[a-z]+\|>", -1), unescaped), "")
        return F.struct(role.alias("role"), text.alias("text"))

    learnt = F.zip_with("pieces", "turns", lambda p, t: F.transform(t["loss"], lambda s: unescaped(F.substring(p, (s["start"] - t["start"] - len(START) + 1).cast("int"), s["chars"].cast("int")))))
    return out.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns_read"), F.array_join(F.flatten(learnt), "").alias("loss_text"))
