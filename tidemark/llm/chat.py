"""Chat transcripts to canonical turns, roles recovered by a hidden Markov model.

A transcript is a sequence of lines. Hidden states are (role, first line of a turn
or a further one); a further line keeps its role. A line is observed as its
speaker marker ("User:", "### Assistant", "[system]", none), whether it is blank, and a
length class. Transition, start and observation chances are counted (add-one) on
labelled turns by aggregates. Viterbi gives the likeliest states; lines are
gathered into turns, markers stripped, and turns rendered canonically.

Scale: the lines get global numbers in (conversation, order) and are cut into
blocks of ``BLOCK`` lines whatever the conversations' sizes, so one with a third of
all lines is many blocks. A block reduces the (at most two) conversations that
cross its ends to their best scores from each entering to each leaving state (a
max-plus matrix); a conversation's matrices, one per ``BLOCK`` lines, are chained and
give the states at the block ends; each block then finds its own lines' states between them.
The result is the Viterbi path of the whole conversation. Turn numbers are counts in the block plus the
counts of the conversation's earlier blocks.

Cases: null text is one empty line; null conversation ids are one conversation; null
order sorts first; a null or other role doesn't train; rows of one conversation and turn, equal or not, follow each
other by a checksum of role and text, then by their place in the written input, and each keeps its lines
together (between them no step is trained); conversations of any length; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.relational import materialize
from .common import only
from .sharding import global_numbers

ROLES = ("system", "user", "assistant")
STATES = [(r, b) for r in ROLES for b in (True, False)]
BLOCK = 8192
LENGTHS = (40, 120, 300, 700)
N_SYMBOLS = (len(ROLES) + 1) * (len(LENGTHS) + 2)

_NAMES = {"system": "system|instructions?|context", "user": "user|human|question|q|prompt|customer|me",
          "assistant": "assistant|ai|bot|answer|a|model|agent|response"}
#: a speaker at the start of a line, in brackets or hashes, or before a colon
_MARKER = re.compile(
    r"\s*(?:#{2,}\s*(?P<h>%s)\s*:?|\[(?P<b>%s)\]\s*:?|<\|?(?P<t>%s)\|?>|\*\*(?P<s>%s):?\*\*:?|(?P<c>%s)\s*:)(?:\s|$)" % (("|".join(_NAMES.values()),) * 5),
    re.IGNORECASE)
_ROLE_OF = {r: re.compile(f"(?:{n})$", re.IGNORECASE) for r, n in _NAMES.items()}


def marker(line: str) -> tuple[int, int]:
    """(role number or -1, length of the marker) at the start of a line."""
    m = _MARKER.match(line)
    if not m:
        return -1, 0
    name = next(g for g in m.groups() if g)
    return next(i for i, r in enumerate(ROLES) if _ROLE_OF[r].match(name)), m.end()


def symbols(lines: list[str]) -> np.ndarray:
    """The observed symbol of each line."""
    out = np.empty(len(lines), np.int64)
    for i, x in enumerate(lines):
        role, _ = marker(x)
        size = 0 if not x.strip() else 1 + sum(len(x) > c for c in LENGTHS)
        out[i] = (role + 1) * (len(LENGTHS) + 2) + size
    return out


@dataclass
class Hmm:
    """Log chances: first state, state to state, state to symbol."""

    start: np.ndarray
    step: np.ndarray
    seen: np.ndarray

    def path(self, symbol: np.ndarray, enter: int = -1, leave: int = -1) -> np.ndarray:
        """Likeliest states of consecutive lines, entered from state ``enter`` (-1: a
        conversation's start) and ending in ``leave`` (-1: any)."""
        n = len(symbol)
        emit = self.seen[:, symbol].T
        back = np.zeros((n, len(STATES)), np.int64)
        best = (self.start if enter < 0 else self.step[enter]) + emit[0]
        for t in range(1, n):
            ways = best[:, None] + self.step
            back[t] = ways.argmax(0)
            best = ways.max(0) + emit[t]
        out = np.empty(n, np.int64)
        out[-1] = best.argmax() if leave < 0 else leave
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def reduce(self, symbol: np.ndarray) -> np.ndarray:
        """Best scores of consecutive lines: rows enter from each state and, last, from
        a conversation's start; columns leave in each state."""
        emit = self.seen[:, symbol].T
        best = np.vstack([self.step, self.start]) + emit[0]
        for e in emit[1:]:
            best = (best[:, :, None] + self.step[None]).max(1) + e
        return best


def transcript_lines(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                     text_col: str = "text") -> DataFrame:
    """Turns as raw transcript lines (conv, turn, tie, row, pos, line, role, first), each
    conversation in one of four styles: "User: ...", a "### User" line, "[user] ..." or
    only a blank line between turns. ``tie`` and ``row`` tell the rows of one turn apart: a checksum, and
    the place in the input, which is written so that it stays."""
    t = only(turns, conv_col, turn_col, role_col, text_col).select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = materialize(t.select("*", F.xxhash64("role", "text").alias("tie"), F.monotonically_increasing_id().alias("row")), "chats")
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    style = F.pmod(F.xxhash64("conv"), F.lit(4))
    text = (F.when(style == 0, F.concat(F.initcap(role), F.lit(": "), F.col("text")))
            .when(style == 1, F.concat(F.lit("### "), F.initcap(role), F.lit("\n"), F.col("text")))
            .when(style == 2, F.concat(F.lit("["), role, F.lit("] "), F.col("text")))
            .otherwise(F.concat(F.lit("\n"), F.col("text"))))
    return t.select("conv", "turn", "tie", "row", "role", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).withColumn(
        "first", F.col("pos") == 0)


def fit(lines: DataFrame) -> Hmm:
    """Counts over labelled lines (as of ``transcript_lines``)."""
    known = lines.where(F.col("role").isin(*ROLES))
    number = F.create_map(*[x for i, r in enumerate(ROLES) for x in (F.lit(r), F.lit(2 * i))])
    state = F.element_at(number, F.col("role")) + F.when(F.col("first"), 0).otherwise(1)

    def symbol_rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(symbols(b.column(1).to_pylist()))], names=["state", "symbol"])

    seen = np.ones((len(STATES), N_SYMBOLS))
    for r in (known.select(state.cast("int").alias("state"), "line").mapInArrow(symbol_rows, "state int, symbol long")
              .groupBy("state", "symbol").count().collect()):  # states x symbols at most
        seen[r["state"], r["symbol"]] += r["count"]
    turn = known.groupBy("conv", "turn", "tie", "row").agg(F.first("role").alias("role"), F.max("pos").alias("last"))
    turn = turn.withColumn("state", F.element_at(number, F.col("role")))
    start = np.zeros(len(STATES))
    start[::2] = 1
    for r in turn.groupBy("conv").agg(F.min_by("state", F.struct("turn", "tie", "row")).alias("state")).groupBy("state").count().collect():
        start[r["state"]] += r["count"]
    step = np.zeros((len(STATES), len(STATES)))
    step[:, ::2] = 1  # any state to the first line of a turn ...
    for s in range(0, len(STATES), 2):
        step[s, s + 1] = step[s + 1, s + 1] = 1  # ... or on within the turn
    for r in turn.groupBy("state").agg(F.sum(F.when(F.col("last") > 0, 1).otherwise(0)).alias("one"),
                                       F.sum(F.greatest(F.col("last") - 1, F.lit(0))).alias("more")).collect():
        step[r["state"], r["state"] + 1] += r["one"]
        step[r["state"] + 1, r["state"] + 1] += r["more"]
    # from the last row of a turn to the first of the next: one of each, however many rows a turn has
    place = F.struct("tie", "row")
    once = turn.groupBy("conv", "turn").agg(F.min_by("state", place).alias("to"), F.max_by(
        F.col("state") + F.when(F.col("last") > 0, 1).otherwise(0), place).alias("from"))
    then = once.select("conv", (F.col("turn") - 1).alias("turn"), "to")
    for r in once.drop("to").join(then, ["conv", "turn"]).groupBy("from", "to").count().collect():
        step[r["from"], r["to"]] += r["count"]
    with np.errstate(divide="ignore"):
        return Hmm(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), np.log(seen / seen.sum(1, keepdims=True)))


def _segments(table: pa.Table):
    """(order of the block's lines, their symbols, [(conversation, first, end)])."""
    order = np.argsort(np.asarray(table["_number"].combine_chunks()), kind="stable")
    table = table.take(pa.array(order))
    conv = table["conv"].to_pylist()
    cut = [i for i in range(len(conv)) if i == 0 or conv[i] != conv[i - 1]] + [len(conv)]
    lines = [x or "" for x in table["line"].to_pylist()]
    return table, lines, symbols(lines), [(conv[a], a, b) for a, b in zip(cut, cut[1:])]


def recover(lines: DataFrame, model: Hmm, *order: str) -> DataFrame:
    """Lines (``conv``, ``line`` and the ``order`` columns within a conversation) with the
    recovered ``role``, ``turn`` (0, 1, ... in the conversation) and ``_number``, markers stripped."""
    kind = dict(lines.dtypes)["conv"]
    numbered, _ = global_numbers(lines.select("conv", *order, "line"), "conv", *order)
    numbered = numbered.select("conv", "line", "_number", F.floor(F.col("_number") / BLOCK).cast("long").alias("_block"))
    key = pa.int64() if kind in ("bigint", "long") else None

    def ends(table: pa.Table) -> pa.Table:
        table, _, symbol, parts = _segments(table)
        at = table["_block"][0].as_py()
        some = [parts[0]] + ([parts[-1]] if len(parts) > 1 else [])
        return pa.table({"conv": pa.array([c for c, _, _ in some], table["conv"].type if key is None else key),
                         "_block": pa.array([at] * len(some), pa.int64()),
                         "best": pa.array([model.reduce(symbol[a:b]).ravel() for _, a, b in some], pa.list_(pa.float64()))})

    def chain(table: pa.Table) -> pa.Table:
        """States at the block ends of a conversation that lies in two blocks or more."""
        order_ = np.argsort(np.asarray(table["_block"].combine_chunks()))
        blocks = np.asarray(table["_block"].combine_chunks())[order_]
        n = len(STATES)
        enter, leave = np.full(len(blocks), -1), np.full(len(blocks), -1)
        if len(blocks) > 1:
            best = [np.array(table["best"][int(i)].as_py()).reshape(n + 1, n) for i in order_]
            score, back = best[0][n], []
            for m in best[1:]:
                ways = score[:, None] + m[:n]
                back.append(ways.argmax(0))
                score = ways.max(0)
            leave[-1] = score.argmax()
            for t in range(len(blocks) - 1, 0, -1):
                enter[t] = leave[t - 1] = back[t - 1][leave[t]]
        return pa.table({"conv": table["conv"].take(pa.array(order_)), "_block": blocks,
                         "enter": pa.array(enter, pa.int32()), "leave": pa.array(leave, pa.int32())})

    def states(table: pa.Table, bounds: pa.Table) -> pa.Table:
        table, text, symbol, parts = _segments(table)
        known = {c: (e, l) for c, e, l in zip(bounds["conv"].to_pylist(), bounds["enter"].to_pylist(), bounds["leave"].to_pylist())}
        role, begin, turn, out = [], [], [], []
        for i, (c, a, b) in enumerate(parts):
            edge = i == 0 or i == len(parts) - 1
            path = model.path(symbol[a:b], *(known.get(c, (-1, -1)) if edge else (-1, -1)))
            first = path % 2 == 0
            role += [STATES[s][0] for s in path]
            begin.append(first)
            turn.append(np.cumsum(first))
        begin, turn = np.concatenate(begin), np.concatenate(turn)
        for line, first in zip(text, begin.tolist()):
            out.append(line[marker(line)[1]:] if first else line)
        return pa.table({"conv": table["conv"], "line": pa.array(out, pa.string()), "_number": table["_number"], "_block": table["_block"],
                         "role": pa.array(role, pa.string()), "_first": pa.array(begin), "_turn": pa.array(turn, pa.int64())})

    bounds = (numbered.groupBy("_block").applyInArrow(ends, f"conv {kind}, _block long, best array<double>")
              .groupBy("conv").applyInArrow(chain, f"conv {kind}, _block long, enter int, leave int"))
    found = (numbered.groupBy("_block").cogroup(bounds.groupBy("_block")).applyInArrow(
        states, f"conv {kind}, line string, _number long, _block long, role string, _first boolean, _turn long"))
    found = materialize(found, "states")
    # one row per conversation and block
    turns = found.groupBy("conv", "_block").agg(F.max("_turn").alias("n"))
    before = W.partitionBy("conv").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    turns = materialize(turns.select(F.col("conv").alias("_conv"), F.col("_block").alias("_in"),
                                     F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")), "turns")
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_in"))
    return found.join(turns, same).select("conv", (F.col("_turn") + F.col("_before") - 1).alias("turn"), "role", "_first", "_number", "line")


def render(recovered: DataFrame) -> DataFrame:
    """Canonical turns (conv, turn, role, text, rendered) of recovered lines. A first line
    that was nothing but a marker or a blank is not part of the text."""
    lines = F.array_sort(F.collect_list(F.when(~F.col("_first") | (F.col("line") != ""), F.struct("_number", "line"))))
    turns = recovered.groupBy("conv", "turn").agg(F.first("role").alias("role"), lines.alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return turns.select("conv", "turn", "role", text.alias("text")).withColumn(
        "rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>")))


def trained_on(conv):
    """Four fifths of the conversations, by a checksum of the id, carry labels."""
    return F.coalesce(F.crc32(conv.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """Every conversation as a raw transcript, parsed back into canonical turns. The
    roles of four fifths of the conversations train the model; none is read in parsing."""
    lines = transcript_lines(turns, conv_col, turn_col, role_col, text_col)
    model = fit(lines.where(trained_on(F.col("conv"))))
    return render(recover(lines, model, "turn", "tie", "row", "pos")).withColumnRenamed("conv", conv_col)
