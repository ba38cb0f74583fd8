"""Chat formatting in Spark expressions only.

A conversation's turns are collected as structs and sorted; neighbours of one role are merged into one block, in which
their texts stay apart by a separator; blocks are concatenated.

    ### User: first text
    <+>
    second text
    </turn>
    ### Assistant: ...

Control strings inside texts are escaped by one more backslash before them and before the backslashes that precede them,
and only there, so that removing one undoes it. A marker is never preceded by a backslash, as a line break or the start
stands before it. The loss mask is run-length coded over the code points of the output; it covers assistant texts alone.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template. Roles with a name of their own; others are written as Role(url-encoded).
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
OPEN, BETWEEN, CLOSE = "### ", "\n<+>\n", "\n</turn>\n"
CONTROL = r"(?:### |</turn>|<\+>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)(\\*{CONTROL})", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*{CONTROL})", "$1")


def _shown(role: Column) -> Column:
    out = F.concat(F.lit("Role("), F.url_encode(role), F.lit(")"))
    for name, shown in NAMES.items():
        out = F.when(role == name, F.lit(shown)).otherwise(out)
    return out


def _role(shown: Column) -> Column:
    out = F.url_decode(F.regexp_extract(shown, r"^Role\((.*)\)$", 1))
    for name, mark in NAMES.items():
        out = F.when(shown == mark, F.lit(name)).otherwise(out)
    return out


def formatted(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, mask (array of runs: chars, loss): one row a conversation.

    Rows go by turn, ties by role and text; repeated rows stay. A null text or role counts as empty, a null turn comes
    first, null conversation ids are one conversation. A conversation is one row, so it must fit in memory, however many
    turns it has and however long they are. An empty table gives an empty result; other columns are not read, whatever
    their names.
    """
    rows = turns.select(
        F.col(f"`{conversation}`").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).alias("row"),
    )
    t = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("t"))
    # where a run of one role starts, and where the next does (positions from 1)
    t = t.withColumn("starts", F.expr("filter(sequence(1, size(t)), i -> i = 1 OR t[i - 1].role <> t[i - 2].role)"))
    t = t.withColumn("runs", F.expr("zip_with(starts, concat(slice(starts, 2, size(starts)), array(size(t) + 1)), (a, b) -> struct(t[a - 1].role AS role, transform(slice(t, a, b - a), x -> x.text) AS texts))"))
    blocks = F.transform("runs", lambda r: F.struct(F.concat(F.lit(OPEN), _shown(r["role"]), F.lit(": ")).alias("head"), F.transform(r["texts"], escaped).alias("texts"), (r["role"] == "assistant").alias("loss")))
    t = t.select("conv_id", blocks.alias("blocks"))
    whole = F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], BETWEEN), F.lit(CLOSE))), "")
    run = lambda chars, loss: F.struct(F.length(chars).alias("chars"), loss.alias("loss"))
    no = F.lit(False)
    texts = lambda b: F.transform(b["texts"], lambda x, i: F.array(run(F.when(i == 0, b["head"]).otherwise(F.lit(BETWEEN)), no), run(x, b["loss"])))
    mask = F.transform("blocks", lambda b: F.concat(F.flatten(texts(b)), F.array(run(F.lit(CLOSE), no))))
    return t.select("conv_id", whole.alias("formatted"), F.flatten(mask).alias("mask"))


def parsed(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss (array of unescaped masked texts), formatted: read back from `formatted`
    and `mask` alone, each in one pass whatever the number of turns. Takes what `formatted` gives, null ids included; an
    empty table gives an empty result."""
    blocks = F.filter(F.split("formatted", r"\n</turn>\n"), lambda b: b != "")
    head = r"^### ([^:]*): "
    of = lambda b: F.transform(F.split(F.regexp_replace(b, head, ""), r"\n<\+>\n"), lambda x: F.struct(_role(F.regexp_extract(b, head, 1)).alias("role"), unescaped(x).alias("text")))
    # four bytes a code point, so that a run is cut out without reading what stands before it; with a byte order mark of its
    # own, one that the text begins with stays
    run = lambda r: F.concat(F.unhex(F.lit("0000FEFF")), F.substring(F.col("code_points"), r["start"] * 4 + 1, r["chars"] * 4))
    loss = F.transform(_lossy("mask"), lambda r: unescaped(F.decode(run(r), "UTF-32")))
    runs = chats.withColumn("code_points", F.encode("formatted", "UTF-32"))
    return runs.select("conv_id", F.flatten(F.transform(blocks, of)).alias("turns"), loss.alias("loss"), "formatted")


def _lossy(mask: str, chunk: int = 256) -> Column:
    """start (from 0), chars of the mask's runs of loss. Running sums go by chunks, and over the chunks' totals, as an array
    that grows run by run would be copied each time."""
    from_zero = lambda sums: F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    parts = F.transform(F.sequence(F.lit(0), F.expr(f"greatest(size({mask}) - 1, 0) div {chunk}")), lambda c: F.slice(mask, (c * chunk + 1).cast("int"), chunk))
    sums = F.transform(parts, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, r: a + r["chars"]))
    whole = F.arrays_zip(parts.alias("part"), F.slice(from_zero(sums), 1, F.size(sums)).alias("before"))

    def within(x):
        starts = from_zero(F.transform(x["part"], lambda r: r["chars"].cast("long")))
        each = F.zip_with(x["part"], F.slice(starts, 1, F.size(x["part"])), lambda r, at: F.struct((at + x["before"]).cast("int").alias("start"), r["chars"].alias("chars"), r["loss"].alias("loss")))
        return F.filter(each, lambda r: r["loss"])

    return F.flatten(F.transform(whole, within))
