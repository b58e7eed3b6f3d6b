"""Chat formatting with Spark expressions only.

A conversation becomes one string. Turns are sorted inside a collected array of structs, neighbours
with the same role are merged into one block by an array aggregation, and blocks are concatenated::

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n

``<|im_sep|>`` stands between the texts of a merged block, so that the turns can be read back. In
texts and roles a backslash is doubled and ``<|`` becomes ``<\\|``; no control string of the template
can thus arise from data. A line feed in a role is written ``<|im_nl|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import pick

START, END, SEP, NL = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|im_nl|>"


def _lit(x: str) -> Column:
    return F.lit(x)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, _lit("\\"), _lit("\\\\")), _lit("<|"), _lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, _lit("<\\|"), _lit("<|")), _lit("\\\\"), _lit("\\"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside a lambda an expression is computed for each element."""
    return F.get(F.transform(F.array(value), body), _lit(0))


#: Elements whose running sums are made by appending; longer arrays go in slices of this length.
SLICE = 512


def _appended(lengths: Column, start: Column, gap: int) -> Column:
    return F.aggregate(lengths, F.array(start), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n + gap)))


def running_sums(lengths: Column, gap: int = 0) -> Column:
    """The sums of all elements before each one, ``gap`` added for each of these; as many as there are elements.

    Appending copies an array for each element, so that sums are made slice by slice, from a first pass over the slices' totals.
    """

    def sliced(every: Column) -> Column:
        count = F.ceil(F.size(every) / SLICE).cast("int")
        slices = F.transform(F.sequence(_lit(0), count - 1), lambda i: F.slice(every, i * SLICE + 1, F.lit(SLICE)))
        totals = lambda parts: F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, n: a + n + gap))
        starts = lambda parts: _appended(totals(parts), F.lit(0).cast("long"), 0)
        inside = lambda p, start: F.slice(_appended(p, start, gap), F.lit(1), F.size(p))
        of = lambda parts: _let(starts(parts), lambda at: F.flatten(F.transform(parts, lambda p, i: inside(p, F.get(at, i)))))
        return F.when(F.size(every) == 0, F.array().cast("array<bigint>")).otherwise(_let(slices, of))

    return _let(F.transform(lengths, lambda n: n.cast("long")), sliced)


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans) with one row per conversation.

    ``turns`` has conv_id, turn, role and text. Turns are ordered by turn (null first); equal turn
    numbers by role and then text, and repeated rows stay repeated. A null text or role counts as the
    empty string; rows with a null conv_id form one conversation of their own; an empty table gives no
    rows. Other columns are ignored. loss_spans are [begin, end) code-point ranges of ``formatted``,
    one for each text of a role in ``loss_roles``, without separators. The row of a conversation
    holds all its text, so a conversation has to fit in one row; nothing else is gathered by key.
    """
    rows = pick(turns, "conv_id", "turn", "role", "text").select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), _lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), _lit("")).alias("text"),
        ).alias("_turn"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    safe = F.transform(
        "_turns",
        lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text")),
    )
    # A block begins where the role is not that of the turn before, and ends where the next one begins.

    def merged(turns: Column) -> Column:
        begins = F.filter(F.transform(turns, lambda t, i: F.when((i == 0) | (F.get(turns, i - 1)["role"] != t["role"]), i)), lambda i: i.isNotNull())
        block = lambda at: lambda i, k: F.struct(F.get(turns, i)["role"].alias("role"), F.transform(F.slice(turns, i + 1, F.coalesce(F.get(at, k + 1), F.size(turns)) - i), lambda t: t["text"]).alias("texts"))
        return _let(begins, lambda at: F.transform(at, block(at)))

    blocks = chats.select("conv_id", _let(safe, merged).alias("_blocks"))
    head = lambda b: F.concat(_lit(START), F.replace(escape(b["role"]), _lit("\n"), _lit(NL)), _lit("\n"))
    whole = lambda b: F.concat(head(b), F.array_join(b["texts"], SEP), _lit(END + "\n"))
    parts = blocks.select("conv_id", "_blocks", F.transform("_blocks", whole).alias("_parts"), F.transform("_blocks", lambda b: F.length(head(b))).alias("_heads"))
    # Offsets: running sums of the lengths of blocks, and of texts inside a block.
    parts = parts.withColumn("_at", running_sums(F.transform("_parts", F.length)))
    spans = F.flatten(
        F.transform(
            F.arrays_zip(F.col("_blocks").alias("b"), F.col("_heads").alias("h"), F.col("_at").alias("at")),
            lambda z: F.when(
                z["b"]["role"].isin(*loss_roles),
                F.transform(
                    F.arrays_zip(
                        z["b"]["texts"].alias("t"),
                        running_sums(F.transform(z["b"]["texts"], F.length), len(SEP)).alias("o"),
                    ),
                    lambda y: F.struct(
                        (z["at"] + z["h"] + y["o"]).cast("long").alias("begin"),
                        (z["at"] + z["h"] + y["o"] + F.length(y["t"])).cast("long").alias("end"),
                    ),
                ),
            ).otherwise(F.array().cast("array<struct<begin:bigint,end:bigint>>")),
        )
    )
    return parts.select("conv_id", F.array_join("_parts", "").alias("formatted"), spans.alias("loss_spans"))


def read_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_text) parsed from the strings that ``format_chats`` made.

    turns is an array of (role, text), one for each original turn; loss_text is what stands under the
    loss spans, in their order, unescaped and joined without anything between. The string is parted once, and spans are
    laid beside the texts by sorting both by their places; only a span that is not that of a whole text is cut out by itself.
    """
    body = lambda b: F.substring(b, F.length(_lit(START)) + 1, F.length(b))
    role = lambda b: unescape(F.replace(F.substring_index(body(b), "\n", 1), _lit(NL), _lit("\n")))
    texts = lambda b: F.split(F.substring(b, F.locate("\n", b) + 1, F.length(b)), r"\Q" + SEP + r"\E", -1)
    block = lambda b: F.struct(role(b).alias("role"), texts(b).alias("texts"), F.locate("\n", b).alias("head"), F.length(b).alias("size"))
    rows = chats.select("conv_id", "formatted", "loss_spans", F.transform(F.filter(F.split("formatted", r"\Q" + END + r"\E\n", -1), lambda b: b != ""), block).alias("_blocks"))
    rows = rows.withColumn("_starts", running_sums(F.transform("_blocks", lambda b: b["size"]), len(END) + 1))
    turns = F.flatten(F.transform("_blocks", lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text")))))

    def placed(block: Column, start: Column) -> Column:
        item = lambda at: lambda t, i: _place(start + F.get(at, i), 0, start + F.get(at, i) + F.length(t), t)
        return _let(running_sums(F.transform(block["texts"], F.length), len(SEP)), lambda at: F.transform(block["texts"], item(at)))

    texts_there = F.flatten(F.transform("_blocks", lambda b, k: placed(b, F.get(F.col("_starts"), k) + b["head"])))
    spans_there = F.transform("loss_spans", lambda s: _place(s["begin"], 1, s["end"], F.lit(None).cast("string")))
    by_place = F.sort_array(F.concat(texts_there, spans_there))
    under = lambda before, s: F.when((before["kind"] == 0) & (before["at"] == s["at"]) & (before["to"] == s["to"]), before["text"]).otherwise(
        F.substring(F.col("formatted"), (s["at"] + 1).cast("int"), (s["to"] - s["at"]).cast("int"))
    )
    masked = _let(by_place, lambda every: F.transform(every, lambda s, i: F.when(s["kind"] == 1, unescape(F.coalesce(under(F.get(every, i - 1), s), under(s, s))))))
    return rows.select("conv_id", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))


def _place(begin: Column, kind: int, end: Column, text: Column) -> Column:
    """A text (kind 0) or a span (kind 1) of the formatted string; at one place texts come before spans."""
    return F.struct(begin.cast("long").alias("at"), _lit(kind).alias("kind"), end.cast("long").alias("to"), text.alias("text"))
