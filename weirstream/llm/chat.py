"""Chat formatting from event logs (operator 12, native).

A log holds what happened to the messages of conversations: messages begin, text
is streamed in deltas, texts are edited, answers are generated anew. The log is
partitioned by conversation, put in order and folded: the final text of a message
is what was written since it was last begun, edited or thrown away. The final
messages are rendered by a template, in which control strings of the texts are
escaped so that they can be read back; the loss mask covers the texts of some roles.

Which event resets which message follows from maxima of sequence numbers, so a
conversation's events are dealt by runs of turns, and a hot one over many tasks.
Runs are rendered where they lie; only rendered runs meet in a conversation's row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

#: What an event does: ``begin`` opens a message with a role (and text), ``delta`` appends, ``edit`` puts a text in
#: place of all before, ``regenerate`` empties a message and takes back those of later turns, ``delete`` takes one out.
KINDS = ("begin", "regenerate", "edit", "delta", "delete")
#: Turns of a conversation that are put together in one place.
RUN = 32


@dataclass(frozen=True)
class Template:
    """A turn is ``begin``, role, line feed, opening, text, closing, ``end``; roles are written as in URLs.

    ``wraps`` gives opening and closing of a role. ``trained``: roles whose texts the loss mask covers.
    """

    begin: str = "<s>"
    end: str = "</s>"
    wraps: tuple[tuple[str, str, str], ...] = (("user", "[INST] ", " [/INST]"),)
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        firsts = {c[0] for c in self.controls}
        for c in self.controls:
            if len(c) < 2 or c[0] in "\n \\%" or c[0].isalnum() or firsts & set(c[1:]) or "\\" in c:
                raise ValueError(f"a control string begins with a sign that none holds further on, and has no backslash: {c!r}")

    @property
    def controls(self) -> tuple[str, ...]:
        """Strings that mark turns, which no text may hold."""
        parts = [self.begin, self.end, *(p for _, *ps in self.wraps for p in ps)]
        return tuple(dict.fromkeys(p.strip() for p in parts if p.strip()))

    def _replaced(self, text: Column, found: str, by: str) -> Column:
        """Over each first sign of control strings, where any backslashes and the rest of one follow."""
        for first in dict.fromkeys(c[0] for c in self.controls):
            rest = "|".join(re.escape(c[1:]) for c in self.controls if c[0] == first)
            text = F.regexp_replace(text, rf"{re.escape(first)}{found}(?=\\*(?:{rest}))", f"{re.escape(first)}{by}" if first == "$" else f"{first}{by}")
        return text

    def escaped(self, text: Column) -> Column:
        """A backslash more after the first sign of every control string, however many there are: ``</s>`` becomes ``<\\/s>``."""
        return self._replaced(text, "", r"\\")

    def unescaped(self, text: Column) -> Column:
        """What was escaped: a backslash less."""
        return self._replaced(text, r"\\", "")

    def _wrap(self, role: Column, which: int) -> Column:
        out = F.lit("")
        for name, *parts in self.wraps:
            out = F.when(role == name, F.lit(parts[which])).otherwise(out)
        return out

    def head(self, role: Column) -> Column:
        return F.concat(F.lit(self.begin), F.url_encode(role), F.lit("\n"), self._wrap(role, 0))

    def tail(self, role: Column) -> Column:
        return F.concat(self._wrap(role, 1), F.lit(self.end))

    def is_trained(self, role: Column) -> Column:
        return role.isin(*self.trained) if self.trained else F.lit(False)

    def turns(self, formatted: Column) -> Column:
        """The rendered turns of a conversation, without ``end``."""
        return F.filter(F.split(formatted, re.escape(self.end)), lambda x: x != "")

    def role_of(self, turn: Column) -> Column:
        return F.url_decode(F.substr(F.substring_index(turn, "\n", 1), F.lit(len(self.begin) + 1)))

    def text_of(self, turn: Column) -> Column:
        role = self.role_of(turn)
        body = F.substr(turn, F.instr(turn, "\n") + F.lit(1))
        opening, closing = F.length(self._wrap(role, 0)), F.length(self._wrap(role, 1))
        return self.unescaped(F.substr(body, opening + 1, F.length(body) - opening - closing))


def _keyed(rows: DataFrame) -> DataFrame:
    """With the keys ``c`` and ``r`` of a conversation and a run of its turns, which are never null."""
    c = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    return rows.withColumn("c", c).withColumn("r", F.coalesce(F.floor(F.col("turn") / RUN).cast("long"), F.lit(-(1 << 63))))


def _folded(log: DataFrame) -> DataFrame:
    """The messages that are left, dealt by ``c`` and ``r``."""
    events = log.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        "branch",
        "kind",
        F.struct("seq", F.array_position(F.lit(list(KINDS)), F.col("kind")).alias("step")).alias("place"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).filter(F.col("kind").isin(*KINDS) & F.col("place.seq").isNotNull())
    last = lambda value, *kinds: F.max(F.when(F.col("kind").isin(*kinds), value))
    place = F.col("place")
    written = F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text"))
    messages = (
        _keyed(events)
        .repartition("c", "r")
        .groupBy("c", "r", "turn", "branch")
        .agg(
            F.first("conv_id").alias("conv_id"),
            F.collect_list(F.when(F.col("kind") == "delta", F.struct("place", "text"))).alias("deltas"),
            last(F.struct("place", "text", "role"), "begin").alias("begun"),
            last(F.struct("place", written.alias("text")), "begin", "regenerate", "edit").alias("reset"),
            last(place, "regenerate").alias("again"),
            last(place, "delete").alias("deleted"),
        )
    )
    # what later turns had until a regenerate is taken back: the last one of earlier turns of the run, or of earlier runs
    takes = F.when(F.col("turn").isNotNull(), F.col("again"))
    earlier = Window.partitionBy("c", "r").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    took = F.when((F.col("kind") == "regenerate") & F.col("turn").isNotNull(), place)
    runs = _keyed(events.select("conv_id", "turn", took.alias("took"))).groupBy("c", "r").agg(F.max("took").alias("took"))
    before = F.max("took").over(Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("c", "r", before.alias("before")).filter("before IS NOT NULL")
    messages = messages.withColumn("inside", F.max(takes).over(earlier)).join(runs, ["c", "r"], "left")
    messages = messages.withColumn("cut", F.greatest("inside", F.when(F.col("turn").isNotNull(), F.col("before"))))
    gone = F.greatest("cut", "deleted")
    messages = messages.filter(F.col("begun").isNotNull() & (gone.isNull() | (F.col("begun.place") > gone)))
    since = F.array_sort(F.filter("deltas", lambda x: x["place"] > F.col("reset.place")))
    text = F.concat(F.col("reset.text"), F.array_join(F.transform(since, lambda x: x["text"]), ""))
    return messages.select("c", "r", "conv_id", "turn", "branch", F.col("begun.role").alias("role"), text.alias("text"))


def fold(log: DataFrame) -> DataFrame:
    """The final messages of a log: conv_id, turn, branch, role, text.

    ``log``: conv_id, turn, branch (tells messages of one turn apart), seq (the
    order of a conversation's events; any type that has an order), kind (one of
    ``KINDS``), role, text; other columns are not read. A message has no row if
    it never begins, was deleted after it began, or was taken back by a
    ``regenerate`` of an earlier turn after it began. Its role is that of its
    last ``begin``. Null roles and texts are empty; null ids, turns and branches
    are values of their own, and a ``regenerate`` without a turn empties its
    message only. Events without a known kind or a seq do nothing. Events of a
    message with the same seq are taken in the order of ``KINDS``, those of one
    kind by text and role. A delta that is there twice counts twice. An empty
    log gives no rows.
    """
    return _folded(log).drop("c", "r")


def formatted(log: DataFrame, template: Template | None = None) -> DataFrame:
    """The conversations of a log (see ``fold``): conv_id, n_turns, formatted, loss_spans.

    ``loss_spans``: array of struct<turn, start, place, length>; ``turn`` counts the
    rendered turns from 1, ``place`` counts code points from 1 in the turn, and
    ``start`` (from 0) in the whole. Messages of one turn come in the order of
    role, text and branch, those without turn first. A conversation of which no
    message is left has no row.

    A hot conversation is rendered by runs of ``RUN`` turns. Its text must fit a
    row, whose task holds it.
    """
    t = template or Template()
    messages = _folded(log).withColumn("inner", t.escaped(F.col("text"))).withColumn("head", t.head(F.col("role")))
    messages = messages.withColumn("rendered", F.concat("head", "inner", t.tail(F.col("role")))).withColumn("size", F.length("rendered").cast("long"))
    order = Window.partitionBy("c", "r").orderBy("turn", "role", "text", "branch")
    span = F.when(t.is_trained(F.col("role")), F.struct((F.length("head") + 1).alias("place"), F.length("inner").alias("length")))
    messages = messages.select(
        "c", "r", "conv_id", "rendered", "size", span.alias("span"),
        F.row_number().over(order).alias("nth"), (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
    )
    joined = lambda parts: F.array_join(F.transform(F.array_sort(parts), lambda x: x["rendered"]), "")
    runs = messages.groupBy("c", "r").agg(
        F.first("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("size"),
        joined(F.collect_list(F.struct("nth", "rendered"))).alias("rendered"),
        F.array_sort(F.collect_list(F.when(F.col("span").isNotNull(), F.struct("nth", "start", "span")))).alias("spans"),
    )
    earlier = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("at", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    spans = F.transform("spans", lambda x: F.struct(
        (F.col("first") + x["nth"]).cast("int").alias("turn"), (F.col("at") + x["start"] + x["span"]["place"] - 1).alias("start"),
        x["span"]["place"].alias("place"), x["span"]["length"].alias("length"),
    ))
    return runs.groupBy("c").agg(
        F.first("conv_id").alias("conv_id"),
        F.sum("n").alias("n_turns"),
        joined(F.collect_list(F.struct("r", "rendered"))).alias("formatted"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("r", spans.alias("spans")))), lambda x: x["spans"])).alias("loss_spans"),
    ).drop("c")


def read_back(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """``rows`` of ``formatted`` with ``messages`` (array of role, text) and ``trained`` (array of the texts under the mask), read from the rendered text."""
    t = template or Template()
    (cut,) = fresh(rows, "cut")
    columns = rows.columns
    rows = rows.withColumn(cut, t.turns(F.col("formatted")))
    messages = F.transform(cut, lambda x: F.struct(t.role_of(x).alias("role"), t.text_of(x).alias("text")))
    trained = F.transform("loss_spans", lambda x: t.unescaped(F.substr(F.element_at(F.col(cut), x["turn"]), x["place"], x["length"])))
    return rows.select(*columns, messages.alias("messages"), trained.alias("trained"))


def logged(rows: DataFrame, piece: int = 256) -> DataFrame:
    """The log that would have led to ``rows`` (conv_id, turn, role, text).

    Answers are streamed in deltas of ``piece`` code points, once as far as the
    first delta, and whole when they are generated anew. What others write
    begins with its first piece and is then edited to the whole. Rows with the
    same conversation and turn are messages of their own.
    """
    text = F.coalesce("text", F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    first = F.coalesce(F.get("pieces", F.lit(0)), F.lit(""))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    streamed = F.concat(
        F.array(event("begin", F.lit("")), event("delta", first), event("regenerate", F.lit(""))), F.transform("pieces", lambda x: event("delta", x))
    )
    edited = F.array(event("begin", first), event("edit", text))
    base = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.monotonically_increasing_id().alias("branch"))
    base = base.withColumn("pieces", F.when(F.col("role") == "assistant", pieces))
    events = base.select("conv_id", "turn", "branch", "role", F.posexplode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("nth", "event"))
    seq = F.struct("turn", "branch", F.col("nth").alias("nth"))
    return events.select("conv_id", "turn", "branch", seq.alias("seq"), "event.kind", "role", "event.text")
