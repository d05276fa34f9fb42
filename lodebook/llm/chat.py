"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. Successive prefixes of a conversation are
rendered, and each output is compared with the one before: what was added is the span of the new turn, and an
output that does not begin with the one before comes from a template that rewrites history, which is reported
at the turn where it happens. The text of an assistant turn inside its span, found by rendering the turn with a
mark for its text, is under the loss mask; a template that alters what stands around a text gives no mask.

Where a template rewrites, the pieces are cut anew from the last output, each behind the end of the text before it, so
joined pieces are the last output for every template.

Every prefix is rendered, at every length, so that what is reported of a turn never depends on how long the conversation is.
That costs the square of the turns. A caller who cannot pay it may bound `Incremental`: with `dense` a prefix is rendered each
time the conversation has grown by one part in `dense`, and the pieces of the turns between are taken from renderings of the
last `window` turns and count only if, joined to the output before, they are equal to the new one (if not, every prefix between
is rendered); with `held` a conversation of which more than so many characters have been formatted goes on as a new one that
begins with its last `window` turns. Rewrites that are undone between two such prefixes, or of turns before those, go unseen then.

Turns are ordered by turn, role and text, nulls first. Null role and text are empty, rows with a null
conversation id form one conversation, repeated rows are turns of their own. Rows are streamed from a
sorted partition; one conversation and its output are held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodebook.llm import arrays
from lodebook.session import ship_package

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
WINDOW = 32
ASSISTANT = "assistant"
MARK = "\ue000"

_ESCAPED = re.compile(r"[\\<>\n]")
_BACK = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn ((?:[^\\<>\n]|\\.)*)>\n((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    """A backslash before every backslash and opening bracket, so that no text holds a control string.

    In a role closing brackets and line ends (as \\n) are escaped as well.
    """
    if role:
        return _ESCAPED.sub(lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], text)
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str, role: bool = False) -> str:
    return _BACK.sub(lambda m: "\n" if role and m[1] == "n" else m[1], text)


def turn_template(turns: list[Turn]) -> str:
    """`<turn role>`, the escaped text and `</turn>` for each turn, each marker followed by a line end."""
    return "".join(f"<turn {escape(role, True)}>\n{escape(text)}</turn>\n" for role, text in turns)


def read_back(output: str) -> tuple[list[Turn], bool]:
    """The turns of a formatted text, and whether all of it was understood."""
    turns, rest = read_turns(output)
    return turns, not rest


def read_turns(output: str) -> tuple[list[Turn], str]:
    """The turns with which a formatted text begins, and the rest."""
    turns, at = [], 0
    for m in _TURN.finditer(output):
        if m.start() != at:
            break
        turns.append((unescape(m[1], True), unescape(m[2])))
        at = m.end()
    return turns, output[at:]


Piece = tuple[str, str, int, int, bool]  # role, piece, loss start and end in the piece, was earlier output rewritten


class Incremental:
    """Finds each turn's piece of the output of a template while turns are added."""

    def __init__(self, template: Template, dense: int | None = None, window: int = WINDOW, held: int | None = None):
        self.template, self.dense, self.window, self.held = template, dense, window, held
        self.turns: list[Turn] = []
        self.pieces: list[Piece] = []  # of the first turns, whose rendering is `shown`
        self.shown, self.given, self.waiting = "", 0, 0

    def add(self, turn: Turn) -> list[Piece]:
        """Adds a turn; gives the pieces that are finished, which are none below `held` characters, if that is given."""
        self.turns.append(turn)
        self.waiting += len(turn[1])
        waiting = len(self.turns) - len(self.pieces)
        if self.dense is None or waiting > len(self.turns) // self.dense or (self.held is not None and self.waiting > self.held // 8):
            self._confirm()
        if self.held is None or len(self.shown) <= self.held or len(self.turns) <= self.window:
            return []
        done = self.finish()
        self.turns = self.turns[-self.window:]
        self.shown, self.given = self.template(self.turns), len(self.turns)
        self.pieces = [("", "", 0, 0, False)] * self.given
        return done

    def finish(self) -> list[Piece]:
        """The pieces of all turns that have not been given yet."""
        self._confirm()
        if any(piece[4] for piece in self.pieces):
            self.pieces = self._cut_again()
        return self.pieces[self.given:]

    def _confirm(self) -> None:
        first, turns, self.waiting = len(self.pieces), self.turns, 0
        if len(turns) - first > 1:
            base = max(0, first - self.window)
            shown, guessed = self.template(turns[base:first]), []
            for number in range(first, len(turns)):
                piece, shown = self._piece(turns[base:number], turns[number], shown)
                guessed.append(piece)
            now = self.template(turns)
            if not any(g[4] for g in guessed) and now == self.shown + "".join(g[1] for g in guessed):
                self.pieces += guessed
                self.shown = now
                return
        for number in range(first, len(turns)):
            piece, self.shown = self._piece(turns[:number], turns[number], self.shown)
            self.pieces.append(piece)

    def _piece(self, before: list[Turn], turn: Turn, shown: str) -> tuple[Piece, str]:
        """The piece that a turn adds to the output of those before it, and the output with it."""
        now = self.template([*before, turn])
        if not now.startswith(shown):
            return (turn[0], "", 0, 0, True), now
        piece = now[len(shown):]
        first = last = 0
        if turn[0] == ASSISTANT:
            # A mark in the text's place shows what surrounds the text.
            marked = self.template([*before, (turn[0], MARK)])[len(shown):]
            ahead, _, behind = marked.partition(MARK)
            if piece.startswith(ahead) and piece.endswith(behind) and len(ahead) + len(behind) <= len(piece):
                first, last = len(ahead), len(piece) - len(behind)
        return (turn[0], piece, first, last, False), now

    def _cut_again(self) -> list[Piece]:
        """Pieces of the last output, each from the end of the text before it to the end of its own."""
        spans, end, mark = [], 0, MARK
        while mark in self.shown:
            mark = f"{MARK}{mark}\ue001"
        for number, (role, _) in enumerate(self.turns):
            marked = self.template([*self.turns[:number], (role, mark), *self.turns[number + 1:]])
            at = marked.find(mark)
            last = len(self.shown) - (len(marked) - at - len(mark))
            found = end <= at <= last and marked[:at] == self.shown[:at] and marked[at + len(mark):] == self.shown[last:]
            start, end = end, last if found else end
            spans.append([start, end, at if found else end])
        if spans:
            spans[-1][1] = len(self.shown)
        pieces = []
        for (role, _), (start, stop, at), (*_, again) in zip(self.turns, spans, self.pieces, strict=True):
            last = end if stop == len(self.shown) else stop
            masked = role == ASSISTANT and at < last
            pieces.append((role, self.shown[start:stop], at - start if masked else 0, last - start if masked else 0, again))
        return pieces


PIECES = ("conv_id long, turn_no long, role string, piece string, start long, loss_start long, loss_end long, "
          "rewritten boolean")
ROWS_OUT = 512


def format_conversations(rows: DataFrame, template: Template = turn_template) -> DataFrame:
    """One row per turn of conversations (conv_id, turn, role, text): its piece of the output and where it stands.

    The pieces of a conversation in the order of turn_no are its formatted text; start is where the piece
    begins, loss_start and loss_end (from there) the part under the loss mask. Rows of a conversation stay together
    and in order within a partition.
    """
    spark = rows.sparkSession
    ship_package(spark)
    dealt = (rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
             .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")
             .sortWithinPartitions("conv_id", "turn", "role", "text"))
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = ()
        state, number, at = Incremental(template), 0, 0
        out: list[tuple] = []

        def put(pieces: list[Piece]) -> None:
            nonlocal number, at
            for role, piece, first, last, rewritten in pieces:
                out.append((current, number, role, piece, at, first, last, rewritten))
                number, at = number + 1, at + len(piece)

        def batch_of(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)

        for batch in batches:
            columns = [arrays.column(batch, c).to_pylist() for c in ("conv_id", "role", "text")]
            for conv, role, text in zip(*columns, strict=True):
                if conv != current:
                    put(state.finish())
                    current, state, number, at = conv, Incremental(template), 0, 0
                put(state.add((role, text)))
                while len(out) >= ROWS_OUT:
                    yield batch_of(out[:ROWS_OUT])
                    out = out[ROWS_OUT:]
        put(state.finish())
        for k in range(0, len(out), ROWS_OUT):
            yield batch_of(out[k:k + ROWS_OUT])

    return dealt.mapInArrow(run, PIECES)


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says, read back from the pieces (as `format_conversations` orders them)."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewritten"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = ()
        out: list[tuple] = []
        turns = loss = None
        n = chars = size = again = 0
        rest = ""

        def close() -> None:
            if rest:
                raise ValueError(f"conversation {current}: the formatted text can't be read back")
            if turns is not None:
                out.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), size, again))

        for batch in batches:
            columns = [arrays.column(batch, c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end", "rewritten")]
            for conv, piece, first, last, rewritten in zip(*columns, strict=True):
                if conv != current or turns is None:
                    close()
                    current, turns, loss, n, chars, size, again = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                found, rest = read_turns(rest + piece)
                for role, text in found:
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                learned = unescape(piece[first:last])
                loss.update(learned.encode())
                chars, size, again = chars + len(learned), size + len(piece), again + bool(rewritten)
            if len(out) >= ROWS_OUT:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return pieces.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                  "formatted_chars long, n_rewritten long")


AWKWARD = r"\### Assistant: </turn> ok"


def with_awkward_turns(rows: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose texts hold control strings."""
    more = rows.sparkSession.createDataFrame(
        [(-7, 0, "user", AWKWARD), (-7, 1, ASSISTANT, AWKWARD)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(more)
