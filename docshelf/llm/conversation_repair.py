"""Repair of conversation structure by depth-first branch-and-bound.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``: at most one system
message, then user and assistant in turn. Edits: Keep a message (0), Rerole it to user or assistant
(3), Delete it (4; blank messages and repeats must go), Insert an empty user or assistant message (3);
a truncated message that stays costs 3 more. Of the cheapest repairs the one whose audit (the initials of
its edits) is least in ASCII order is taken.

The search keeps an explicit stack of prefixes. A prefix is dropped when its cost plus the lower bound
of what is left cannot beat the incumbent (cost, audit), or when the dominance table of its node (messages read, place in
the pattern) holds a prefix that is no worse. The bounds are suffix sums over a relaxation that forgets the audit; children are
taken by bound, then by letter, so the first leaf is nearly always the optimum and the rest of the stack
only proves it.

How it is spread: messages are range-sorted by conversation and turn, so a long conversation spans many
tasks. A conversation that lies inside one partition and has at most 1,024 messages is repaired there. The others (at
most two at the edges of each partition, and the long ones) are cut into pieces of 1,024 messages: each piece is
searched once for every place of the pattern it may start and end in, the pieces of a conversation are then
chosen from last to first (one small row per piece), and the edits go back to the pieces. An Insert belongs to the
message after it, so audits of one piece are never prefixes of each other and the least audit of the whole is made of
least audits of its pieces. Only the digest of a conversation's repaired text needs its messages in one sequence; they
are streamed through it in sorted order.

Defined results: a null role or text is one space, so a null text is blank and a null role has to be changed. A null conversation id is a
conversation of its own. Turns are sorted with nulls first; messages of the same turn by the first 8 characters of the
role, the first 32 of the text, and then by hashes of both. Rows that repeat are repeats like any other. A role counts by its first character; an empty role
has none and is never legal. Very long texts are read whole. Rows flagged as gone only say that the conversation exists: without
other rows it gives zeros, an empty audit and no message. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_lookup
from .common import written

WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)                 # what the repaired messages so far end in
LEGAL = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = (USER, USER, ASSISTANT, USER)                      # the place after an inserted or reroled message
NAME = {USER: "user", ASSISTANT: "assistant"}
PAIRS = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT, UNMENDED = 0, 3, 4, 3, 3
FINISH = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
PIECE = 1024
NEVER = 1 << 60

FACTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, sha string"
TABLE = (f"kind string, conv string, part int, at bigint, sub int, turn string, role string, text string, mark string, "
         f"done struct<{FACTS.replace(' bigint', ':bigint').replace(' string', ':string')}>")


def fault_of(text: str) -> str:
    """``b`` for blank, ``t`` for truncated, else empty."""
    words = text.strip(WHITE)
    return "b" if not words else "" if words[-1] in ".!?" else "t"


def _moves(i: int, place: int, initials: Sequence[str], faults: Sequence[str]):
    """``letter, cost, next message, next place`` of every edit open at a node."""
    yield "D", DELETE, i + 1, place
    yield "I", INSERT, i, NEXT[place]
    if faults[i] in ("b", "d"):
        return
    extra = UNMENDED if faults[i] == "t" else 0
    if (place, initials[i]) in LEGAL:
        yield "K", KEEP + extra, i + 1, LEGAL[place, initials[i]]
    yield "R", REROLE + extra, i + 1, NEXT[place]


def suffix_bounds(initials: Sequence[str], faults: Sequence[str], finish: dict[int, tuple[int, str]]) -> list[list[int]]:
    """``[i][place]``: what the messages from ``i`` on cost at least, whatever the audit."""
    bounds = [[finish.get(p, (NEVER, ""))[0] for p in range(4)]]
    for i in range(len(initials) - 1, -1, -1):
        after, here = bounds[-1], [NEVER] * 4
        for p in range(4):
            here[p] = min(cost + after[q] for _, cost, j, q in _moves(i, p, initials, faults) if j > i)
        for _ in range(2):      # two inserts in a row lead from any place to any other that inserts reach
            here = [min(here[p], INSERT + here[NEXT[p]]) for p in range(4)]
        bounds.append(here)
    return bounds[::-1]


def search(initials: Sequence[str], faults: Sequence[str], start: int = START,
           finish: dict[int, tuple[int, str]] = FINISH) -> tuple[int, str] | None:
    """Cheapest (cost, audit) from ``start`` through all messages to a place of ``finish``, None if there is none.

    ``finish`` gives, by place, what it costs to end there and the edits that follow.
    """
    n, bounds = len(initials), suffix_bounds(initials, faults, finish)
    best: tuple[int, str] | None = None
    dominance: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    stack = [(0, start, 0, "")]
    while stack:
        i, place, cost, audit = stack.pop()
        least = cost + bounds[i][place]
        if least >= NEVER or best is not None and (least, audit) > (best[0], best[1][:len(audit)]):
            continue
        known = dominance[i].get(place)
        if known is not None and known <= (cost, audit):
            continue
        dominance[i][place] = (cost, audit)
        if i == n:
            end, letters = finish[place]
            if best is None or (cost + end, audit + letters) < best:
                best = (cost + end, audit + letters)
            continue
        children = sorted((cost + c + bounds[j][q], letter, j, q, cost + c) for letter, c, j, q in _moves(i, place, initials, faults))
        stack.extend((j, q, c, audit + letter) for _, letter, j, q, c in reversed(children))
    return best


def applied(audit: str, rows: Sequence, start: int = START) -> Iterator[tuple[int, str, str, str]]:
    """``row number, letter, role, text`` of the messages that an audit leaves or adds; ``rows`` of (role, text)."""
    at, place = 0, start
    for letter in audit:
        if letter == "D":
            at += 1
        elif letter == "K":
            role, text = rows[at]
            place = LEGAL[place, role[:1]]
            yield at, letter, role, text
            at += 1
        else:
            place = NEXT[place]
            yield at, letter, NAME[place], "" if letter == "I" else rows[at][1]
            at += letter == "R"


def _counts(turns: Sequence[int | None], initials: Sequence[str], faults: Sequence[str]) -> dict:
    known = [t for t in turns if t is not None]
    return {"gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
            "blank": sum(f == "b" for f in faults), "duplicate": sum(f == "d" for f in faults),
            "truncated": sum(f == "t" for f in faults),
            "illegal": sum(a + b not in PAIRS for a, b in zip(initials, initials[1:]))}


def repaired(rows: Sequence[tuple[int | None, str, str]]) -> tuple[dict, list[tuple[int, str, str, str]]]:
    """Facts and repaired messages of one conversation, ``rows`` of (turn, role, text) in order."""
    faults, met = [], set()
    for _, role, text in rows:
        fault = fault_of(text)
        faults.append("d" if fault != "b" and (role, text) in met else fault)
        met.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    cost, audit = search(initials, faults)
    messages = list(applied(audit, [r[1:] for r in rows]))
    sha = hashlib.sha256("\n".join(f"{role}:{text}" for _, _, role, text in messages).encode()).hexdigest()
    return _counts([r[0] for r in rows], initials, faults) | {"cost": cost, "audit": audit, "sha": sha}, messages


def _ordered(convs: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, gone: Column) -> DataFrame:
    space = F.lit(" ")
    rows = convs.select(
        F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-")).alias("conv"),
        F.col(turn_col).cast("bigint").alias("turn"), gone.alias("gone"),
        F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), space).alias("text"))
    rows = rows.select("conv", "turn", "gone", *[F.when(~F.col("gone"), F.col(c)).alias(c) for c in ("role", "text")])
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.asc(F.left(F.col("role"), F.lit(8))),
             F.asc(F.left(F.col("text"), F.lit(32))), F.asc(F.xxhash64("role", "text")), F.asc("copy")]
    return (rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .select(F.spark_partition_id().alias("part"), "conv", F.col("turn").cast("string").alias("turn"), "gone", "role", "text"))


def _repair_inside(ordered: DataFrame, messages: bool) -> DataFrame:
    """One table: ``done`` rows of conversations repaired here, their messages if asked for, and ``open`` rows."""
    columns = ["kind", "conv", "part", "at", "sub", "turn", "role", "text", "mark", "done"]

    def closed(conv: str, part: int, rows: list) -> Iterator[tuple]:
        live = [(None if t is None else int(t), role, text) for _, t, gone, role, text in rows if not gone]
        at = [p for p, _, gone, _, _ in rows if not gone]
        facts, made = repaired(live)
        yield "done", conv, part, rows[0][0], 0, None, None, None, None, facts
        if messages:
            for sub, (k, letter, role, text) in enumerate(made):
                yield "message", conv, part, at[k] if k < len(at) else rows[-1][0] + 1, sub, None, role, text, letter, None

    def left_open(conv: str, part: int, rows: list) -> Iterator[tuple]:
        for p, turn, gone, role, text in rows:
            yield "open", conv, part, p, 0, turn, role, text, "g" if gone else fault_of(text), None

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, rows, is_open, at, part = None, [], True, 0, 0
        for b in batches:
            out: list[tuple] = []
            for part, key, turn, gone, role, text in zip(b["part"], b["conv"], b["turn"], b["gone"], b["role"], b["text"]):
                if key != conv:
                    if rows:
                        out.extend((left_open if is_open else closed)(conv, part, rows))
                    is_open, conv, rows = conv is None, key, []      # the first one may have begun before
                rows.append((at, turn, gone, role, text))
                at += 1
                if len(rows) > PIECE:
                    is_open = True
                if is_open and len(rows) >= PIECE:
                    out.extend(left_open(conv, part, rows))
                    rows = []
            yield pd.DataFrame(out, columns=columns)
        if rows:                                                      # the last one may go on
            yield pd.DataFrame(list(left_open(conv, part, rows)), columns=columns)

    return ordered.mapInPandas(walk, TABLE)


def _pieces(open_rows: DataFrame) -> DataFrame:
    """``conv, part, piece, facts``: each piece's counts, ends and best edits by place of start and end (JSON)."""
    rows = open_rows.select("conv", "part", "at", "turn", F.left(F.col("role"), F.lit(1)).alias("initial"), "mark",
                            F.when(~F.col("mark").isin("g", "b"), F.sha2(F.concat_ws(
                                ":", F.length("role"), "role", "text"), 256)).alias("digest"))
    first = (rows.where("digest IS NOT NULL").groupBy("conv", "digest")
             .agg(F.min(F.struct("part", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    rows = salted_lookup(rows, first, ["conv", "digest"], ["part", "at"], 16, "left")
    repeat = F.col("first").isNotNull() & (F.col("first") != F.struct("part", "at"))
    rows = rows.select("conv", "part", "at", "turn", "initial", F.when(repeat, "d").otherwise(F.col("mark")).alias("mark"),
                       F.expr(f"at DIV {PIECE}").alias("piece"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("at")
        live = g[g["mark"] != "g"]
        initials, faults = live["initial"].to_list(), live["mark"].to_list()
        turns = [int(t) for t in live["turn"] if t is not None]
        facts = {"n": len(live), "ends": [initials[0], initials[-1]] if initials else [], "distinct": len(set(turns)),
                 "turns": [min(turns), max(turns)] if turns else [],
                 **{k: v for k, v in _counts([], initials, faults).items() if k != "gaps"},
                 "best": [[search(initials, faults, p, {q: (0, "")}) for q in range(4)] for p in range(4)]}
        return pd.DataFrame([(g["conv"].iloc[0], g["part"].iloc[0], g["piece"].iloc[0], json.dumps(facts))],
                            columns=["conv", "part", "piece", "facts"])

    return rows.groupBy("conv", "part", "piece").applyInPandas(one, "conv string, part int, piece bigint, facts string")


def compose(pieces: Sequence[dict]) -> tuple[dict, list[tuple[int, str]]]:
    """Facts of a conversation from its pieces in order, and for each piece where it starts and its edits."""
    live = [p for p in pieces if p["n"]]
    facts = {k: sum(p[k] for p in live) for k in ("blank", "duplicate", "truncated", "illegal")}
    facts["illegal"] += sum(a["ends"][1] + b["ends"][0] not in PAIRS for a, b in zip(live, live[1:]))
    timed = [p for p in live if p["turns"]]
    shared = sum(a["turns"][1] == b["turns"][0] for a, b in zip(timed, timed[1:]))
    facts["gaps"] = (timed[-1]["turns"][1] - timed[0]["turns"][0] + 1 - sum(p["distinct"] for p in timed) + shared
                     if timed else 0)
    least, chosen = {q: FINISH[q][0] for q in range(4)}, []
    for p in reversed(pieces):
        options = {s: [(best[0] + least[q], best[1], q) for q, best in enumerate(p["best"][s]) if best is not None and q in least]
                   for s in range(4)}
        chosen.append({s: min(o) for s, o in options.items() if o})
        least = {s: o[0] for s, o in chosen[-1].items()}
    place, edits = START, []
    for step in reversed(chosen):
        _, audit, q = step[place]
        edits.append((place, audit))
        place = q
    facts["cost"] = least[START]
    edits[-1] = (edits[-1][0], edits[-1][1] + FINISH[place][1])
    return facts | {"audit": "".join(a for _, a in edits), "sha": None}, edits


def _repair_pieces(open_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv, done`` of the conversations that were cut, and their messages."""
    done_type = TABLE[TABLE.index("struct<"):]

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["part", "piece"])
        facts, edits = compose([json.loads(f) for f in g["facts"]])
        done = [facts] + [None] * (len(g) - 1)
        return pd.DataFrame({"conv": g["conv"], "part": g["part"], "piece": g["piece"], "place": [p for p, _ in edits],
                             "edits": [a for _, a in edits], "done": done})

    chosen = written(_pieces(open_rows).groupBy("conv").applyInPandas(
        choose, f"conv string, part int, piece bigint, place int, edits string, done {done_type}"), "conversation-edits")

    def edit(rows: pd.DataFrame, how: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["mark"] != "g"].sort_values("at")
        at, h = rows["at"].to_list(), how.iloc[0]
        made = applied(h["edits"], list(zip(rows["role"], rows["text"])), h["place"])
        return pd.DataFrame([(h["conv"], h["part"], at[k] if k < len(at) else (h["piece"] + 1) * PIECE, sub, role, text, letter)
                             for sub, (k, letter, role, text) in enumerate(made)],
                            columns=["conv", "part", "at", "sub", "role", "text", "mark"])

    keys = ["conv", "part", "piece"]
    messages = (open_rows.withColumn("piece", F.expr(f"at DIV {PIECE}")).select(*keys, "at", "role", "text", "mark").groupBy(*keys)
                .cogroup(chosen.select(*keys, "place", "edits").groupBy(*keys))
                .applyInPandas(edit, "conv string, part int, at bigint, sub int, role string, text string, mark string"))
    return chosen.where("done IS NOT NULL").select("conv", "done"), messages


def _digests(messages: DataFrame) -> DataFrame:
    """``conv, sha``: SHA-256 of each conversation's ``role:text`` lines, streamed in order."""
    order = ["conv", "part", "at", "sub"]
    lines = messages.select(*order, F.concat("role", F.lit(":"), "text").alias("line"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, digest = None, None
        for b in batches:
            out = []
            for key, line in zip(b["conv"], b["line"]):
                if key != conv:
                    if conv is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = key, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            yield pd.DataFrame(out, columns=["conv", "sha"])
        if conv is not None:
            yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv", "sha"])

    return lines.repartition("conv").sortWithinPartitions(*order).mapInPandas(stream, "conv string, sha string")


def _run(convs: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, gone: Column | None,
         messages: bool) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    kind = dict(convs.dtypes)[id_col]
    gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    table = written(_repair_inside(_ordered(convs, id_col, turn_col, role_col, text_col, gone), messages), "conversations")
    done, made = _repair_pieces(table.where("kind = 'open'"))
    conv_id = F.when(F.col("conv") != "-", F.expr("substring(conv, 2)")).cast(kind).alias("conv_id")
    return table, done, made, conv_id


def repair(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``gone`` flags rows that only say that their conversation exists.
    """
    table, cut, made, conv_id = _run(convs, id_col, turn_col, role_col, text_col, gone, False)
    none = hashlib.sha256(b"").hexdigest()
    cut = (cut.join(_digests(made), "conv", "left")
           .withColumn("done", F.col("done").withField("sha", F.coalesce("sha", F.lit(none)))))
    both = table.where("kind = 'done'").select("conv", "done").unionByName(cut.select("conv", "done"))
    facts = [f.split()[0] for f in FACTS.split(", ")]
    return both.select(conv_id, *[F.col(f"done.{f}").alias("repaired_sha256" if f == "sha" else f) for f in facts])


def repaired_messages(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """The repaired messages: ``conv_id, part, at, sub, role, text, edit``, in that order inside a conversation."""
    table, _, made, conv_id = _run(convs, id_col, turn_col, role_col, text_col, gone, True)
    cols = ["conv", "part", "at", "sub", "role", "text", "mark"]
    both = table.where("kind = 'message'").select(*cols).unionByName(made.select(*cols))
    return both.select(conv_id, "part", "at", "sub", "role", "text", F.col("mark").alias("edit"))
