"""Chat formatting by event-sourced reconstruction.

A log holds events (conv_id, seq, message, kind, role, text), in any order. Partitioned by
conversation and sorted by sequence within each message, they are folded in one streaming pass that
holds one message at a time (a fold in order of sequence alone would hold a conversation; the final
messages are the same, as only regenerations reach beyond their message, and their newest sequence
number is carried along):

* `open`, `delta`: appends text to the message (`open` is what first names the role);
* `edit`: replaces the message's text so far;
* `regenerate`: empties the message, and drops what later messages had received before it;
* `delete`: drops the message's events so far;
* `turn`: a whole message of its own.

The final messages are rendered with a template that marks turns and escapes control strings inside
roles and texts, so that a reader gets the exact texts back:

    <turn>### {role}:{newline}{text}</turn>{newline}

In roles and texts a backslash is written twice; `<` before `turn>` or `/turn>` becomes `\\l`, `#`
before `## ` becomes `\\h`; in roles `:` becomes `\\c` and a newline `\\n`. The loss mask covers the
escaped text of the turns whose role is in `loss_roles`.

Output: one row per turn, (conv_id, turn, segment, loss_start, loss_end) with the mask in code
points of the segment; a conversation's segments in turn order are its formatted text. So a very
long conversation is never one value in memory; only its order needs one task.

Defined results: null text or role is empty; null conv_id is a conversation of its own; null
sequence or message numbers sort first; events of one (conversation, message, sequence) are folded
in order of kind and text; an empty table gives no rows; extra columns are not read."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_CONTROL = re.compile(r"\\|<(?=/?turn>)|#(?=## )")
_ROLE = re.compile(r"\\|<(?=/?turn>)|#(?=## )|:|\n")
_CODES = {"\\": "\\\\", "<": "\\l", "#": "\\h", ":": "\\c", "\n": "\\n"}
_BACK = {"\\": "\\", "l": "<", "h": "#", "c": ":", "n": "\n"}
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_SEGMENT = re.compile(r"<turn>### ([^:\n]*):\n(.*)</turn>\n", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    return (_ROLE if role else _CONTROL).sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text) if "\\" in text else text


_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


FLUSH = 1 << 22  # characters of rendered turns that are held at most, but for one turn


def _fold(loss_roles: frozenset[str]):
    def run(batches):
        rows: list[dict] = []
        conv = message = object()
        turn, cut_seq, newest, held = 0, None, None, 0  # newest: of the regenerations of earlier messages
        role, text, alive = "", [], False

        def close():
            nonlocal turn, held
            if alive:
                body = escape("".join(text))
                head = f"<turn>### {escape(role, True)}:\n"
                loss = role in loss_roles
                rows.append({"conv_id": conv, "turn": turn, "segment": f"{head}{body}</turn>\n", "loss_start": len(head) if loss else None, "loss_end": len(head) + len(body) if loss else None})
                turn, held = turn + 1, held + len(body) + 64

        for batch in batches:
            for c, m, seq, kind, who, what in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if c != conv:
                    close()
                    if held > FLUSH:
                        yield pa.RecordBatch.from_pylist(rows, schema=_TURNS)
                        rows, held = [], 0
                    conv, message, turn, cut_seq, newest, alive = c, object(), 0, None, None, False
                    role, text = "", []
                if m != message or kind == "turn":
                    close()
                    message, role, text, alive = m, "", [], False
                    cut_seq = newest
                    if held > FLUSH:
                        yield pa.RecordBatch.from_pylist(rows, schema=_TURNS)
                        rows, held = [], 0
                if cut_seq is not None and (seq is None or seq < cut_seq):
                    continue  # it belonged to a branch that was regenerated
                if kind == "regenerate":
                    text, alive = [], True
                    newest = seq if newest is None or (seq is not None and seq > newest) else newest
                elif kind == "delete":
                    text, alive = [], False
                else:
                    if kind == "edit":
                        text = []
                    text.append(what or "")
                    alive = True
                role = who if who is not None else role
        close()
        yield pa.RecordBatch.from_pylist(rows, schema=_TURNS)

    return run


def events_of(turns: DataFrame) -> DataFrame:
    """Whole turns (conv_id, turn, role, text) as a log of `turn` events, each a message of its own,
    also where turn numbers repeat (then in order of role and text)."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("message"), F.col("turn").cast("long").alias("seq"), F.lit("turn").alias("kind"), say("role"), say("text"))


DELTAS, LEAST_DELTA = 16, 24  # pieces of a streamed text at most, and their characters at least


def streamed(turns: DataFrame) -> DataFrame:
    """Whole turns (conv_id, turn, role, text) as the log of a streaming chat that nets to them.

    Turns are messages in order of turn, role and text (repeated rows are messages of their own). Each
    text comes in deltas. By the hash of a message, it is streamed plainly; or opened with a draft that
    an edit replaces; or drafted and, after the next message had begun, regenerated, which drops that
    beginning; or opened, deleted and opened anew."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), say("role"), say("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("message", F.row_number().over(order).cast("long"))
    size = F.greatest(F.lit(LEAST_DELTA), F.ceil(F.length("text") / DELTAS)).cast("int")
    piece = lambda i: F.substring("text", i * size + 1, size)
    none, draft = F.lit(None).cast("string"), F.lit("draft of </turn> ### ")

    def event(kind, role, text, later=0):
        return F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"), F.lit(later).alias("later"))

    role, start = F.col("role"), piece(F.lit(0))
    first = [
        [event("open", role, start)],
        [event("open", role, draft), event("delta", none, start), event("edit", none, start)],
        [event("open", role, draft), event("delta", none, draft), event("open", F.lit("stale"), draft, 1), event("regenerate", none, none), event("delta", none, start)],
        [event("open", F.lit("gone"), draft), event("delete", none, none), event("open", role, start)],
    ]
    way = F.pmod(F.xxhash64("conv_id", "message", "text"), F.lit(len(first)))
    begun = F.array(*first[0])
    for k in range(1, len(first)):
        begun = F.when(way == k, F.array(*first[k])).otherwise(begun)
    more = F.when(F.length("text") > size, F.transform(F.sequence(F.lit(1), F.ceil(F.length("text") / size).cast("int") - 1), lambda i: event("delta", none, piece(i)))).otherwise(F.array().cast("array<struct<kind: string, role: string, text: string, later: int>>"))
    told = rows.select("conv_id", "message", F.posexplode(F.concat(begun, more)).alias("at", "e"))
    seq = F.col("message") * (2 * DELTAS + 8) + F.col("at")
    return told.select("conv_id", (F.col("message") + F.col("e.later")).alias("message"), seq.alias("seq"), "e.kind", "e.role", "e.text")


def format_chats(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, segment, loss_start, loss_end of the log's final messages."""
    log = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("message").cast("long").alias("message"), F.col("seq").cast("long").alias("seq"), "kind", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = log.repartition("conv_id").sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text")
    return dealt.mapInArrow(_fold(frozenset(loss_roles)), "conv_id long, turn long, segment string, loss_start long, loss_end long")


def _read_back(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    rows: list[tuple] = []
    conv, n, chars, loss_chars, whole, loss = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names)
    for batch in batches:
        for c, segment, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if n and c != conv:
                rows.append((conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
                n, chars, loss_chars, whole, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            conv, n, chars = c, n + 1, chars + len(segment)
            m = _SEGMENT.fullmatch(segment)
            whole.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            if a is not None:
                said = unescape(segment[a:b])
                loss_chars += len(said)
                loss.update(said.encode("utf-8", "surrogatepass"))
        if len(rows) >= 4096:
            yield batch_of()
            rows = []
    if n:
        rows.append((conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
    yield batch_of()


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says: turns and their digest, masked characters and
    their digest, length. Parses the segments; knows nothing of the log."""
    dealt = formatted.select("conv_id", "turn", "segment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return dealt.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
