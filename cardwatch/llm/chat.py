"""Conversations as training text, in DataFrame expressions.

A turn is a list of typed parts.  Text parts are escaped; image, audio and document parts
become numbered placeholders, and what they refer to is recorded with the number of tokens a
placeholder stands for.  Control strings inside texts get a backslash behind their first
character, so none of them occurs in what a turn says, and splitting at them is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Template (fixed values): <s>[ROLE]name[/ROLE]text</s>, with a short form for the usual roles.
TURN_START, TURN_END = "<s>", "</s>"
HEADS = {"user": "[INST]", "system": "[SYS]", "assistant": "[OUT]"}
TAILS = {"user": "[/INST]", "system": "[/SYS]", "assistant": ""}
PLACEHOLDERS = {"image": "[IMG:", "audio": "[AUD:", "document": "[DOC:"}
_REST = r"/?s>|/?(?:INST|SYS|OUT|ROLE)\]|(?:IMG|AUD|DOC):"

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    """Backslashes doubled, then one put behind the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?={_REST})", r"$1\\")


def unescape(text: Column) -> Column:
    """Inverse of `escape`: a lone backslash behind < or [ goes, then doubled ones are halved."""
    return F.replace(F.regexp_replace(text, rf"(?<=[<\[])\\(?={_REST})", ""), F.lit("\\\\"), F.lit("\\"))


def expanded_tokens(part: Column) -> Column:
    """Tokens that a placeholder stands for: one per 14 x 14 image patch, 25 a second, 512 a page; missing sizes count 0."""
    patches = F.ceil(part["width"] / 14) * F.ceil(part["height"] / 14)
    return F.coalesce(
        F.when(part["type"] == "image", patches).when(part["type"] == "audio", F.ceil(part["seconds"] * 25)).when(part["type"] == "document", part["pages"] * 512),
        F.lit(0),
    ).cast("long")


def _visited(part: Column, number: Column) -> Column:
    """Text of one part: escaped text, or the placeholder that bears its number; unknown types are text."""
    marks = [F.concat(F.lit(mark), number.cast("string"), F.lit("]")) for mark in PLACEHOLDERS.values()]
    chain = F
    for kind, mark in zip(PLACEHOLDERS, marks):
        chain = chain.when(part["type"] == kind, mark)
    return chain.otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*PLACEHOLDERS), F.lit(False))


def _chosen(role: Column, by_role: dict[str, str], other: Column) -> Column:
    chain = F
    for name, value in by_role.items():
        chain = chain.when(role == name, F.lit(value))
    return chain.otherwise(other)


def text_parts(text: Column) -> Column:
    """A plain text as its only part."""
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *nothing))


def format_conversations(turns: DataFrame, parts: str = "parts", conversation: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss, attachments.

    `turns` has a column `parts` of type `PARTS`; null parts are no parts, a null text is empty and a
    null role is the empty role.  Rows are put in order of turn, then role, then parts; null turns come first, and
    rows with a null conversation form one.  `loss` lists (start, length) in characters of `formatted`, from 0: what
    assistants say.  `attachments` lists (number, turn_index, type, ref, tokens) by number over the
    conversation.  Other columns are left out.
    """
    a_turn = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(F.col(parts).cast(PARTS), F.array().cast(PARTS)).alias("parts"))
    each = turns.select(F.col(conversation).alias("conv_id"), a_turn.alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    # attachments are numbered through the conversation: those of earlier turns come first
    n_attached = F.transform("rows", lambda r: F.size(F.filter(r["parts"], _is_attachment)))
    each = each.withColumn("n_attached", n_attached).withColumn(
        "first_number",
        F.transform("n_attached", lambda n, i: F.aggregate(F.slice("n_attached", F.lit(1), i), F.lit(0), lambda s, x: s + x)),
    )

    def body(row: Column, index: Column) -> Column:
        numbered = F.transform(
            row["parts"],
            lambda part, at: _visited(part, F.get("first_number", index) + F.size(F.filter(F.slice(row["parts"], F.lit(1), at), _is_attachment))),
        )
        return F.array_join(numbered, "")

    def spoken(row: Column, index: Column) -> Column:
        other = F.concat(F.lit("[ROLE]"), escape(row["role"]), F.lit("[/ROLE]"))
        head = F.concat(F.lit(TURN_START), _chosen(row["role"], HEADS, other))
        tail = F.concat(_chosen(row["role"], TAILS, F.lit("")), F.lit(TURN_END))
        return F.struct(head.alias("head"), body(row, index).alias("body"), tail.alias("tail"), (row["role"] == "assistant").alias("learned"))

    each = each.withColumn("said", F.transform("rows", spoken))
    whole = F.array_join(F.transform("said", lambda t: F.concat(t["head"], t["body"], t["tail"])), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def walk(state: Column, t: Column) -> Column:
        begins = state["at"] + F.length(t["head"])
        span = F.struct(begins.alias("start"), F.length(t["body"]).cast("long").alias("length"))
        spans = F.when(t["learned"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((begins + F.length(t["body"]) + F.length(t["tail"])).alias("at"), spans.alias("spans"))

    attached = F.flatten(
        F.transform(
            "rows",
            lambda row, index: F.transform(
                F.filter(row["parts"], _is_attachment),
                lambda part, at: F.struct(
                    (F.get("first_number", index) + at).alias("number"), index.alias("turn_index"), part["type"].alias("type"), part["ref"].alias("ref"), expanded_tokens(part).alias("tokens")
                ),
            ),
        )
    )
    return each.select("conv_id", whole.alias("formatted"), F.aggregate("said", start, walk)["spans"].alias("loss"), attached.alias("attachments"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation; placeholders stay in the text."""
    pieces = F.filter(F.split(formatted, TURN_END, -1), lambda piece: piece != "")

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(TURN_START) + 1))
        chain = F
        for name, head in HEADS.items():
            text = F.substr(inner, F.lit(len(head) + 1), F.length(inner) - len(head) - len(TAILS[name]))
            chain = chain.when(F.startswith(inner, F.lit(head)), F.struct(F.lit(name).alias("role"), unescape(text).alias("text")))
        named = F.substr(inner, F.lit(len("[ROLE]") + 1))
        at = F.instr(named, "[/ROLE]")
        other = F.struct(unescape(F.substr(named, F.lit(1), at - 1)).alias("role"), unescape(F.substr(named, at + len("[/ROLE]"))).alias("text"))
        return chain.otherwise(other)

    return F.transform(pieces, turn)


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    spans = F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int"))))
    return F.array_join(spans, "")
