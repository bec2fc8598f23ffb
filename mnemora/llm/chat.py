"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering.

A legal conversation is an optional system turn followed by user and assistant turns in alternation,
starting with the user and ending with the assistant.  Dynamic programming over the automaton's
states finds the cheapest edits of a sequence of messages:

* keep a message as its own role: free
* relabel it as another role: RELABEL; a missing or unknown role: RELABEL_UNKNOWN
* merge it into the turn before, if it has that turn's role: MERGE (relabelling is charged too)
* insert an empty turn: INSERT

Of equally cheap repairs the one whose edits come first in the order keep/relabel, merge, insert is
taken, decided message by message from the start; roles count in the order system, user, assistant.

Defined cases: messages are ordered by turn (nulls last), then role, then text (nulls last), so
repeated rows and equal turns have a fixed order; a null text is an empty one; roles are compared
without case and blanks; a row with a null ``conv_id`` is a conversation of its own, as nothing ties
it to others; every conversation has at least one message, as an empty table gives an empty result;
other columns are ignored.  A text can't forge a turn: ``escape`` marks what reads like a marker.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.common import table

SYSTEM, USER, ASSISTANT = 0, 1, 2
ROLES = ("system", "user", "assistant")
#: A wrong label is taken to be rarer than a lost or split turn.
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 2, 7, 1, 4
#: Roles that may follow the turn of each state; the last state is the start.
_START = 3
_NEXT = {_START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_NAMES = {"human": USER, "prompter": USER, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT} | {r: i for i, r in enumerate(ROLES)}


def role_of(name: str | None) -> int | None:
    return _NAMES.get((name or "").strip().lower())


def _insertions() -> dict[tuple[int, int], list[int]]:
    """The shortest sequence of inserted turns that leads from one state to another."""
    best: dict[tuple[int, int], list[int]] = {}
    for s in (_START, SYSTEM, USER, ASSISTANT):
        best[s, s] = []
        queue = [s]
        for at in queue:
            for r in _NEXT[at]:
                if (s, r) not in best:
                    best[s, r] = best[s, at] + [r]
                    queue.append(r)
    return best


_PATH = _insertions()
_STATES = (SYSTEM, USER, ASSISTANT, _START)


def repair(roles: list[int | None]) -> tuple[int, list[tuple[str, int]]]:
    """(cost, edits): each edit is ("turn" | "merge" | "insert", role), messages in order.

    Works backwards, so that ties are decided from the start.
    """
    n = len(roles)
    infinite = 1 << 60
    # to_end[state]: cost of finishing after all messages; a conversation may end only with the assistant
    ahead = [infinite] * 4
    for s in _STATES:
        if (s, ASSISTANT) in _PATH:
            ahead[s] = INSERT * len(_PATH[s, ASSISTANT])
    plan: list[list] = []
    for role in reversed(roles):
        label = [0 if role == r else RELABEL_UNKNOWN if role is None else RELABEL for r in range(3)]
        # without insertions: the message becomes a turn or is merged
        here: list[tuple[int, str, int] | None] = [None] * 4
        for s in _STATES:
            options = [(label[r] + ahead[r], "turn", r) for r in _NEXT[s]]
            if s != _START:
                options.append((label[s] + MERGE + ahead[s], "merge", s))
            here[s] = min(options, key=lambda o: o[0])
        now, choice = [0] * 4, [None] * 4
        for s in _STATES:
            options = [(here[s][0], [], here[s])]
            for t in _STATES:
                path = _PATH.get((s, t))
                if path:
                    options.append((INSERT * len(path) + here[t][0], path, here[t]))
            best = min(options, key=lambda o: o[0])
            now[s], choice[s] = best[0], best[1:]
        plan.append(choice)
        ahead = now
    state, edits = _START, []
    for choice in reversed(plan):
        path, (_, kind, r) = choice[state]
        edits += [("insert", x) for x in path] + [(kind, r)]
        state = r
    edits += [("insert", x) for x in _PATH[state, ASSISTANT]]
    return ahead[_START] if n else INSERT * 2, edits


_MARKER = re.compile(r"<(\\*)\|")


def escape(text: str) -> str:
    """One backslash more between ``<`` and ``|``, which is reversible and leaves all other text alone."""
    return _MARKER.sub(r"<\\\1|", text)


def render(texts: list[str | None], edits: list[tuple[str, int]]) -> tuple[str, int]:
    """The repaired conversation in chat markup, and its number of turns."""
    turns: list[list] = []
    at = 0
    for kind, role in edits:
        if kind == "insert":
            turns.append([role, []])
            continue
        if kind == "turn":
            turns.append([role, []])
        turns[-1][1].append(escape(texts[at] or ""))
        at += 1
    return "".join(f"<|{ROLES[r]}|>\n{'\n\n'.join(parts)}\n<|end|>\n" for r, parts in turns), len(turns)


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, cost, turns, edits, chat) of every conversation."""
    message = F.struct(
        F.col("turn").isNull().alias("late"), "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.col("text").isNull().alias("empty"), F.col("text").alias("text"),
    )
    chats = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"))
    chats = chats.unionByName(conversations.where("conv_id is null").select("conv_id", F.array(message).alias("m")))
    chats = chats.select("conv_id", F.col("m.role").alias("roles"), F.col("m.text").alias("texts"))
    kind = chats.schema["conv_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], []]
            for roles, texts in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist()):
                cost, edits = repair([role_of(r) for r in roles])
                chat, turns = render(texts, edits)
                for column, value in zip(out, (cost, turns, sum(k != "turn" for k, _ in edits), chat)):
                    column.append(value)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *arrays], ["conv_id", "cost", "turns", "edits", "chat"])

    return chats.mapInArrow(run, f"conv_id {kind}, cost long, turns long, edits long, chat string")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
