"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text
is trainable. A conversation is rendered once, each turn as ``<|im_start|>role``, a line break, the
text, ``<|im_end|>`` and a line break. Control strings can't occur inside a text: each ``<``, any number
of backslashes, ``|`` gets one backslash more, and reading takes it off again.

The contexts of one conversation are beginnings of one another, so writing each in full would grow with
the square of its turns. The rendering is therefore also cut into pages of PAGE code points; an example
carries its reply and what of its context is on the last page before it, and refers to the full pages
before that, which all examples of the conversation share. Conversations within a page, nearly all, have
their whole context in each example; ``expansion`` reads all prefixes in full. No task holds a conversation: places of turns are sums over blocks
of turns, and pages are groups of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrove.llm.common import materialise, small_batches

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
#: Code points of a page, and turn numbers of a block.
PAGE, BLOCK = 32_768, 1024


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """A role must stay on its line: backslashes are doubled and line breaks written as ``\\n`` before control strings are escaped."""
    one_line = F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n")
    return escaped(one_line)


@dataclass(frozen=True)
class Formatted:
    """``pages``: key, page, text; ``examples``: key, example, n_context (turns), shared_pages, context, reply, loss_start, loss_end.

    Whole text of an example: its shared pages from 0, its context, its reply; code points loss_start to
    loss_end of that, the reply, are trainable. ``key`` packs the conversation's id, so that null is one.
    """

    pages: DataFrame
    examples: DataFrame


def placed(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """key, block, trained, head, body, start, before: each turn rendered, with the code points and turns of its conversation before it.

    Places are sums within blocks of BLOCK turn numbers, and sums over whole blocks.
    """
    src = turns.select(
        F.struct(F.col(f"`{key}`").alias("id")).alias("key"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))  # null turns come first
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    rendered = src.select("key", "turn", "role", "text", block.alias("block"), (F.col("role") == TRAINED).alias("trained"), head.alias("head"), escaped(F.col("text")).alias("body"))
    rendered = rendered.withColumn("size", (F.char_length("head") + F.char_length("body")).cast("long") + len(END) + 1)
    in_block = Window.partitionBy("key", "block").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    own = rendered.withColumn("start", F.coalesce(F.sum("size").over(in_block), F.lit(0)))
    own = own.withColumn("before", F.count(F.lit(1)).over(in_block)).drop("role", "text", "turn")
    blocks = rendered.groupBy("key", "block").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    over_blocks = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("key", "block", F.coalesce(F.sum("size").over(over_blocks), F.lit(0)).alias("chars"), F.coalesce(F.sum("n").over(over_blocks), F.lit(0)).alias("turns"))
    out = own.join(offsets, ["key", "block"])
    return out.select("key", "trained", "head", "body", (F.col("start") + F.col("chars")).alias("start"), (F.col("before") + F.col("turns")).alias("before"))


def format_conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Formatted:
    """All conversations, rows in order of turn (null first; rows that repeat a turn by role, then text; equal rows each count).

    A null id is a conversation of its own, a null role or text is empty, and an empty table gives
    empty results. Only turns whose role is ``assistant`` are trainable, and a conversation without one
    has pages but no example. Other columns don't matter.
    """
    piece = "struct<page:bigint,start:bigint,part:string,example:struct<before:bigint,at:bigint,reply:string>>"
    rendered = F.concat("head", "body", F.lit(END + "\n"))
    first, at = F.floor(F.col("start") / PAGE), F.col("start") + F.char_length("head")
    last = F.floor((F.col("start") + F.char_length("rendered") - 1) / PAGE)
    own = F.floor(at / PAGE)  # of the page on which the reply begins
    example = F.struct(F.col("before"), at.alias("at"), F.col("body").alias("reply"))

    def part(page: Column) -> Column:
        begin = F.greatest(page * PAGE - F.col("start"), F.lit(0))
        end = (page + 1) * PAGE - F.col("start")
        return F.struct(page.alias("page"), (F.col("start") + begin).alias("start"), F.substring("rendered", (begin + 1).cast("int"), (end - begin).cast("int")).alias("part"),
            F.when(F.col("trained") & (page == own), example).alias("example")).cast(piece)

    # a reply that begins where a page does has no part on the page before; its own page is among the turn's, as END follows it
    rows = placed(turns, key, turn, role, text).withColumn("rendered", rendered)
    rows = rows.select("key", F.explode(F.transform(F.sequence(first, last), part)).alias("p")).select("key", "p.*")
    in_order = F.array_sort(F.collect_list(F.struct("start", "part")))
    pages = rows.groupBy("key", "page").agg(in_order.alias("parts"), F.collect_list("example").alias("examples"))
    pages = materialise(pages.select("key", "page", F.array_join("parts.part", "").alias("text"), "examples"), "chat-pages")
    each = pages.select("key", "page", "text", F.explode("examples").alias("e"))
    context = F.substring("text", F.lit(1), (F.col("e.at") - F.col("page") * PAGE).cast("int"))
    examples = each.select(
        "key", F.col("e.before").alias("n_context"), F.col("page").alias("shared_pages"), context.alias("context"), F.col("e.reply").alias("reply"),
        F.col("e.at").alias("loss_start"), (F.col("e.at") + F.char_length("e.reply")).alias("loss_end"),
    )
    return Formatted(pages.select("key", "page", "text"), examples)


def expansion(found: Formatted) -> DataFrame:
    """key, n_context, start, text, last, loss_start, loss_end: the whole text of every example, prefix and target, in pieces.

    A piece is a page of the prefix, or the rest of it with the reply (``last``); ``start`` is its place in
    the example. The pieces are joined as they are read and not written, whatever the size of a conversation.
    """
    mask = ["loss_start", "loss_end"]
    long = found.examples.filter("shared_pages > 0").select("key", "n_context", "shared_pages", *mask)
    shared = long.join(found.pages, "key").filter("page < shared_pages").select("key", "n_context", (F.col("page") * PAGE).alias("start"), "text", F.lit(False).alias("last"), *mask)
    own = found.examples.select("key", "n_context", (F.col("shared_pages") * PAGE).alias("start"), F.concat("context", "reply").alias("text"), F.lit(True).alias("last"), *mask)
    return own.unionByName(shared)


def expanded(found: Formatted) -> DataFrame:
    """key, n_context, text, loss_start, loss_end: examples with their whole text, which must fit a row; the shared pages are joined in."""
    long = found.examples.filter("shared_pages > 0").select("key", "n_context", "shared_pages")
    pages = long.join(found.pages, "key").filter("page < shared_pages").groupBy("key", "n_context").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("parts"))
    shared = pages.select("key", "n_context", F.array_join("parts.text", "").alias("shared"))
    out = found.examples.join(shared, ["key", "n_context"], "left")
    return out.select("key", "n_context", F.concat(F.coalesce("shared", F.lit("")), "context", "reply").alias("text"), "loss_start", "loss_end")


class Reader:
    """Reads a conversation's pages in order, then what the loss mask leaves of its examples; holds one turn at a time."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.chars = self.loss_chars = self.examples = self.expanded = 0
        self.parts: list[str] = []
        self.tail = ""

    def plain(self, text: str) -> str:
        return re.sub(r"<\\(\\*)\|", r"<\1|", text)

    def page(self, text: str) -> None:
        self.chars += len(text)
        ending = END + "\n"
        at = 0
        while True:
            seen = self.tail + text[at:] if self.tail else text[at:] if at else text
            cut = seen.find(ending)
            if cut < 0:
                keep = min(len(ending) - 1, len(seen))
                self.parts.append(seen[: len(seen) - keep])
                self.tail = seen[len(seen) - keep :]
                return
            at += cut + len(ending) - len(self.tail)
            self.tail = ""
            self.turn("".join([*self.parts, seen[:cut]]))
            self.parts = []

    def turn(self, rendered: str) -> None:
        head, _, body = rendered.partition("\n")
        if not head.startswith(START):
            raise ValueError("a turn must begin with its mark")
        role = self.plain(head[len(START) :])
        role = re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else m[1], role)
        self.turns.update(f"{role}\n{self.plain(body)}\n".encode())
        self.n_turns += 1

    def reply(self, text: str, chars: int) -> None:
        plain = self.plain(text)
        self.loss.update(plain.encode())
        self.loss_chars += len(plain)
        self.examples += 1
        self.expanded += chars

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.examples, self.expanded


REPORT = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, expanded_chars long"


def read_back(found: Formatted) -> DataFrame:
    """key and what its output says: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, expanded_chars.

    formatted_chars are the code points of the rendered conversation, expanded_chars those of the whole
    texts of its examples, counted in all pieces of their prefixes and targets; the loss is what the mask
    leaves of these. A digest of a conversation takes its text in order, so its rows go through one
    task, sorted and one at a time.
    """
    pieces = expansion(found).withColumn("chars", F.char_length("text").cast("long"))
    begin, end = (F.greatest(F.col(c) - F.col("start"), F.lit(0)).cast("int") for c in ("loss_start", "loss_end"))
    trained = pieces.filter("last").select("key", F.lit(1).alias("kind"), F.col("loss_start").alias("at"), F.substring("text", begin + 1, end - begin).alias("text"), "chars")
    before = pieces.filter("NOT last").groupBy("key").agg(F.sum("chars").alias("chars"))
    src = found.pages.select("key", F.lit(0).alias("kind"), F.col("page").alias("at"), "text", F.lit(0).cast("long").alias("chars")).unionByName(trained)
    src = src.unionByName(before.select("key", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("at"), F.lit("").alias("text"), "chars"))
    rows = src.repartition("key").sortWithinPartitions("key", "kind", "at")
    types = {f.name: f.dataType for f in src.schema["key"].dataType.fields}
    schema = f"id {types['id'].simpleString()}, {REPORT}"
    names = ["id", *(c.split()[0] for c in REPORT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        missing = object()
        own, reader = missing, Reader()
        for b in batches:
            key_type, done = b.column(0).field(0).type, []
            for k, kind, text, chars in zip(b.column(0).field(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if own is missing or k != own:
                    if own is not missing:
                        done.append((own, *reader.row()))
                    own, reader = k, Reader()
                if kind == 0:
                    reader.page(text)
                elif kind == 1:
                    reader.reply(text, chars)
                else:
                    reader.expanded += chars
            if done:
                yield batch(done, key_type)
        if own is not missing:
            yield batch([(own, *reader.row())], key_type)

    def batch(done: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in done], t) for j, t in enumerate(kinds)], names=names)

    small_batches(src.sparkSession)
    return rows.mapInArrow(run, schema)
