"""Transcript parsing and chat formatting (operator 7).

A raw transcript is a text whose lines may begin with a speaker marker ("User:", "### Assistant",
"[human]", "<|system|>", "Q.") or with any name ("Kim Lee: ..."). A hidden Markov model reads one
observation a line: the marker's class (a known speaker's role, the first or second unknown name of
the transcript, another name, none) and line features (question, length, blank, first line). Its
states are a role's first line of a turn and its further lines; Viterbi's best path gives the turns, so
a turn whose marker is missing, misleading or unheard of is still recovered from its neighbours and
its lines. Turns are then rendered in one canonical form. A transcript is parsed whole, whatever its
length.

Start, transition and emission tables are counted, with one added to each cell, on a bounded sample of
labelled transcripts (`SAMPLE` of them, `SAMPLE_LINES` lines).

`transcripts` writes raw transcripts from a table of turns, in the order of turns: one for each
conversation, or, for one of more than `PART_TURNS` turns, one for each part of so many. Turns are
numbered by a range sort and the sizes of the ranges before, so a conversation id that a third of
all rows share never meets in one task.

Defined results
    null or empty text    no turn: an empty list, and an empty rendering.
    no marker anywhere    one path by the line features alone; the first turn is never the assistant's
                          unless the model says so.
    ties                  the state that sorts first (system, user, assistant; first line before further).
    null conv_id or turn  a conversation of its own (named ''); null turns come first.
    repeated rows         each is a turn; turns of one number go by role, then by the text's hash.
    null role             the turn gets no marker and counts neither as right nor as wrong.
    empty table           no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.llm.common import cut, pieces

ROLES = ("system", "user", "assistant")
#: Turns of one transcript at most; a longer conversation is written in parts.
PART_TURNS = 2048
#: Labelled transcripts, and lines of them, that the tables are counted on at most.
SAMPLE, SAMPLE_LINES = 2000, 50_000

#: Names of speakers.
SPEAKERS = {
    "system": ["system", "instructions", "context"],
    "user": ["user", "human", "q", "question", "customer", "me", "prompter"],
    "assistant": ["assistant", "ai", "bot", "a", "answer", "agent", "model", "gpt"],
}
_ROLE = {s: r for r, names in SPEAKERS.items() for s in names}
_NAMES = "|".join(sorted(_ROLE, key=len, reverse=True))
_MARKER = re.compile(rf"^\s*(?:#{{1,4}}\s*(?P<a>{_NAMES})\s*:?(?=\s|$)|\[(?P<b>{_NAMES})\]\s*:?|<\|(?P<c>{_NAMES})\|>|\*\*(?P<d>{_NAMES})\s*:?\*\*\s*:?|(?P<e>{_NAMES})\s*[:.>](?=\s|$))[ \t]*", re.I)
_OTHER = re.compile(r"^\s*(?:#{1,4}\s*|\[|<\|?|\*\*)?(?P<name>[^\W\d_][\w'-]{0,20}(?: [^\W\d_][\w'-]{0,20})?)\s*(?:\|?>|\]|\*\*)?:(?=\s|$)[ \t]*")
_MARKS = ("none", "first", "second", "other", *ROLES)


def observe(line: str, first: bool, names: dict[str, int] | None = None) -> tuple[int, int, str]:
    """(marker class, line features, the line without its marker). names: unknown speakers so far."""
    m = _MARKER.match(line)
    if m:
        mark, rest = 4 + ROLES.index(_ROLE[next(g for g in m.groups() if g).lower()]), line[m.end() :]
    elif m := _OTHER.match(line):
        names = {} if names is None else names
        mark, rest = 1 + min(2, names.setdefault(m["name"].casefold(), len(names))), line[m.end() :]
    else:
        mark, rest = 0, line
    n = len(rest.split())
    size = 0 if n == 0 else 1 if n < 6 else 2 if n < 20 else 3 if n < 50 else 4
    return mark, (size * 2 + rest.rstrip().endswith("?")) * 2 + first, rest


def observed(lines: list[str]) -> list[tuple[int, int, str]]:
    """The observations of a transcript; names that mark a single line are no speakers."""
    names: dict[str, int] = {}
    found = [m["name"].casefold() for x in lines if not _MARKER.match(x) and (m := _OTHER.match(x))]
    often = Counter(found)
    for x in found:
        if often[x] > 1:
            names.setdefault(x, len(names))
    for x in often:
        names.setdefault(x, 2)  # after the speakers that come back
    return [observe(x, k == 0, names) for k, x in enumerate(lines)]


N_MARKS, N_FEATURES, N_STATES = len(_MARKS), 20, 2 * len(ROLES)


@dataclass
class Hmm:
    """Logarithms of the tables. State 2 * role is a turn's first line, 2 * role + 1 a further one."""

    start: np.ndarray
    move: np.ndarray
    mark: np.ndarray
    feature: np.ndarray

    @staticmethod
    def counted(samples: list[list[tuple[int, str]]]) -> Hmm:
        """From labelled transcripts: (state, line) of each line."""
        start, move = np.ones(N_STATES), np.ones((N_STATES, N_STATES))
        mark, feature = np.ones((N_STATES, N_MARKS)), np.ones((N_STATES, N_FEATURES))
        for lines in samples:
            seen = observed([line for _, line in lines])
            for k, ((s, _), (m, f, _)) in enumerate(zip(lines, seen, strict=True)):
                mark[s, m] += 1
                feature[s, f] += 1
                if k:
                    move[lines[k - 1][0], s] += 1
                else:
                    start[s] += 1
        start[1::2] = 1e-9  # a transcript begins with a turn's first line
        for r in range(len(ROLES)):
            for q in range(len(ROLES)):
                if q != r:
                    move[2 * r : 2 * r + 2, 2 * q + 1] = 1e-9  # a further line follows its own role
        return Hmm(np.log(start / start.sum()), *[np.log(t / t.sum(axis=1, keepdims=True)) for t in (move, mark, feature)])

    def viterbi(self, lines: list[str]) -> tuple[list[int], list[str]]:
        """The best path, and the lines without their markers."""
        seen = observed(lines)
        if not seen:
            return [], []
        emit = self.mark[:, [m for m, _, _ in seen]].T + self.feature[:, [f for _, f, _ in seen]].T
        best, back = self.start + emit[0], []
        for e in emit[1:]:
            all_ = best[:, None] + self.move
            back.append(all_.argmax(axis=0))
            best = all_.max(axis=0) + e
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        # a marker is only cut off where its line begins a turn
        return path, [rest if s % 2 == 0 else line for s, line, (_, _, rest) in zip(path, lines, seen, strict=True)]

    def turns(self, text: str | None) -> list[tuple[str, str]]:
        """(role, text) of each turn."""
        lines = text.split("\n") if text else []
        path, bodies = self.viterbi(lines)
        out: list[tuple[str, list[str]]] = []
        for s, body in zip(path, bodies, strict=True):
            if s % 2 == 0 or not out:
                out.append((ROLES[s // 2], [body]))
            else:
                out[-1][1].append(body)
        return [(r, "\n".join(b).strip()) for r, b in out]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form; the form's own marks inside a text are taken apart."""
    return "".join(f"<|im_start|>{r}\n{t.replace('<|im_', '<| im_')}<|im_end|>\n" for r, t in turns)


_ADDED = T.StructType([T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))), T.StructField("chat", T.StringType())])


def parse_transcripts(rows: DataFrame, model: Hmm, text_col: str = "transcript") -> DataFrame:
    """The rows with turns (array of role and text) and chat (the canonical rendering) added; row by
    row, no shuffle. Columns with those names are replaced."""
    cols = [c for c in rows.columns if c.lower() not in ("turns", "chat")]
    rows = rows.select(*cols)
    shipped, at = rows.sparkSession.sparkContext.broadcast(model), cols.index(text_col)
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in pieces(batches, 64):
            got = [m.turns(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[{"role": r, "text": t} for r, t in g] for g in got], kind), pa.array([render(g) for g in got], pa.string())], names=[*cols, "turns", "chat"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *_ADDED.fields]))


#: Styles of markers in which raw transcripts are written: (before, after, names of system, user, assistant).
STYLES = [("", ": ", ("System", "User", "Assistant")), ("", ": ", ("Context", "Human", "AI")), ("### ", "\n", ("system", "user", "assistant")), ("[", "] ", ("system", "customer", "agent")), ("<|", "|>\n", ("system", "user", "assistant")), ("", ": ", ("Instructions", "Q", "A")), ("", ": ", ("Moderator", "Kim", "Robin")), ("[", "]: ", ("Host", "guest", "Desk"))]
#: One marker in so many is left out.
LOST = 6


def write_raw(conv: str, turns: list[dict]) -> tuple[str, list[int]]:
    """A raw transcript in a style that the conversation's id picks, some markers left out, though never
    that of the conversation's first turn; and the true state of each line, -1 where the role isn't
    known."""
    before, after, names = STYLES[zlib.crc32(conv.encode()) % len(STYLES)]
    lines: list[str] = []
    states: list[int] = []
    for t in turns:
        role = ROLES.index(t["role"]) if t["role"] in ROLES else -1
        head = f"{before}{names[role]}{after}" if role >= 0 and (t["n"] == 0 or zlib.crc32(f"{conv}:{t['turn']}".encode()) % LOST) else ""
        own = (head + (t["text"] or "")).split("\n")
        lines += own
        states += [2 * role if role >= 0 else -1] + [2 * role + 1 if role >= 0 else -1] * (len(own) - 1)
    return "\n".join(lines), states


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text) with n, the number of each in its conversation from 0. A conversation
    may lie in any number of ranges."""
    # repeated rows are told apart by where they are read, so that any number of them spreads over ranges
    key = ["conv", "turn", "role", "h", "at"]
    order = rows.withColumns({"h": F.xxhash64("text"), "at": F.monotonically_increasing_id()}).repartitionByRange(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, k = TaskContext.get().partitionId(), None, 0
        for b in batches:
            ks = []
            for c in b.column(0).to_pylist():
                k = k + 1 if c == last else 0
                last = c
                ks.append(k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(ks), part, np.int32)), pa.array(ks, pa.int64())], names=["conv", "turn", "role", "text", "range", "k"])

    ranged = cut(order.select("conv", "turn", "role", "text").mapInArrow(run, "conv string, turn long, role string, text string, range int, k long"), "chat-turns")
    # one row for each range that a conversation lies in
    sizes = ranged.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(W.partitionBy("conv").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    sizes = cut(sizes.select("conv", "range", F.coalesce(before, F.lit(0)).alias("before")).filter("before > 0"), "chat-ranges")
    return ranged.join(sizes, ["conv", "range"], "left").select("conv", "turn", "role", "text", (F.col("k") + F.coalesce("before", F.lit(0))).alias("n"))


def transcripts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int | None = None) -> DataFrame:
    """conv_id, part, transcript, states (true state of each line) of each conversation, or of each part
    of `part_turns` turns."""
    most = part_turns or PART_TURNS
    rows = turns.select(F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = _numbered(rows).withColumn("part", F.floor(F.col("n") / most).cast("long"))
    groups = rows.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("n", "turn", "role", "text"))).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 64):
            got = [write_raw(c, t) for c, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.int32()))], names=["conv_id", "part", "transcript", "states"])

    return groups.mapInArrow(run, "conv_id string, part long, transcript string, states array<int>")


def fit(raw: DataFrame, sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> Hmm:
    """Count the tables on the transcripts with the least hashes, `sample` of them and `lines` lines at most
    (one transcript at least), except those held out (crc32(conv_id) mod 4 = 2)."""
    rows = raw.filter(F.crc32(F.col("conv_id").cast("binary")) % 4 != 2).withColumn("h", F.xxhash64("conv_id", "part"))
    total, last = 0, None
    for r in rows.select("h", F.size("states").alias("n")).orderBy("h").limit(sample).collect():
        if total and total + r.n > lines:
            break
        total, last = total + r.n, r.h
    if last is None:
        return Hmm.counted([])
    got = rows.filter(F.col("h") <= last).orderBy("h", "transcript").select("transcript", "states").collect()
    return Hmm.counted([list(zip(r.states, r.transcript.split("\n"), strict=True)) for r in got if r.states and min(r.states) >= 0])
