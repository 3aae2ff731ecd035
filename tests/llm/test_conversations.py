import collections
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from docshelf.llm import conversation_repair as C
from docshelf.llm.q_conversations import damaged, op11_conversation_repair

DDL = "conv_id bigint, turn bigint, role string, text string, conv string, part int, piece bigint, digest string, first string, kind string"
LETTERS = {"system": "s", "user": "u", "assistant": "a"}


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z", "k") for r in rows], DDL).repartition(parts)


def legal(initials):
    body = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (body != "" and len(body) % 2 == 0 and body == "ua" * (len(body) // 2))


def brute(rows):
    """Least (cost, audit, messages) over all edits, with up to two inserts before each message and at the end."""
    met, options = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        must_go = not bare or (role, text) in met
        extra = 0 if must_go or bare[-1] in ".!?" else 3
        met.add((role, text))
        each = [("D", 4, [])]
        if not must_go:
            each += [("K", extra, [(role, text)]), ("R", 3 + extra, [("user", text)]), ("R", 3 + extra, [("assistant", text)])]
        options.append(each)
    inserts = [("", 0, [])] + [("I" * n, 3 * n, [(r, "") for r in rs]) for n in (1, 2)
                               for rs in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for edits in itertools.product(*[itertools.product(inserts, e) for e in options], inserts):
        flat = [x for e in edits[:-1] for x in e] + [edits[-1]]
        cost, audit = sum(x[1] for x in flat), "".join(x[0] for x in flat)
        if best is not None and (cost, audit) >= best[:2]:
            continue
        messages = [m for x in flat for m in x[2]]
        if all(r for r, _ in messages) and legal("".join(r[:1] for r, _ in messages)):
            best = (cost, audit, messages)
    return best


def some_rows(r, n):
    texts = ["Yes.", "No!", "", "  ", "and so", "Yes."]
    return [(r.choice(["user", "assistant", "system", "user", "tool", "assistant"]), r.choice(texts) + r.choice(["", "", str(r.random()) + "."]))
            for _ in range(n)]


def test_search_matches_all_edit_scripts():
    r = random.Random(3)
    for k in range(60):
        rows = some_rows(r, k % 4)
        facts, messages = C.repaired([(i, *x) for i, x in enumerate(rows)])
        cost, audit, want = brute(rows)
        assert (facts["cost"], facts["audit"]) == (cost, audit), rows
        assert [m[2:] for m in messages] == want


def test_pieces_compose_to_the_whole():
    """Any cut into pieces gives the same cost and audit as one search over the whole."""
    r = random.Random(5)
    for _ in range(120):
        n = r.randrange(1, 14)
        initials = [r.choice("uuaast ") for _ in range(n)]
        faults = [r.choice(["", "", "", "t", "b", "d"]) for _ in range(n)]
        cuts = sorted(r.sample(range(n + 1), min(n, 3)))
        pieces = []
        for a, b in zip([0, *cuts], [*cuts, n]):
            part, marks = initials[a:b], faults[a:b]
            pieces.append({"n": b - a, "ends": [part[0], part[-1]] if part else [], "distinct": b - a,
                           "turns": [a, b - 1] if b > a else [], **{k: v for k, v in C._counts([], part, marks).items() if k != "gaps"},
                           "best": [[C.search(part, marks, s, {q: (0, "")}) for q in range(4)] for s in range(4)]})
        facts, edits = C.compose(pieces)
        assert (facts["cost"], facts["audit"]) == C.search(initials, faults)
        assert facts["audit"] == "".join(a for _, a in edits)
        whole = C._counts(list(range(n)), initials, faults)
        assert {k: facts[k] for k in whole} == whole


def test_long_conversation_is_linear():
    for initials in (["u"] * 4000, ["a", "u"] * 2000, ["s"] * 4000, list("uuaa") * 1000):
        cost, audit = C.search(initials, ["t"] * len(initials))
        assert len(audit.replace("I", "")) == 4000 and cost > 0


@pytest.mark.parametrize("piece", [3, 1024])
def test_rows_match_brute_force(spark, monkeypatch, piece):
    """Nulls, blank and very long texts, ties, repeated rows, clashing columns; cut and whole conversations alike."""
    monkeypatch.setattr(C, "PIECE", piece)
    r = random.Random(piece)
    convs = {1: some_rows(r, 3), 2: some_rows(r, 3), 3: [("user", "x" * 200_000 + "."), ("assistant", " " * 300_000 + "a")],
             4: [("user", "Yes."), ("user", "Yes."), ("user", "Yes.")], 5: [("", "Yes."), ("usher", "No.")], 6: [("assistant", "No.")]}
    rows = [(c, 2 * t, *m) for c, ms in convs.items() for t, m in enumerate(ms)]
    rows += [(7, None, None, "Yes."), (7, 3, "assistant", None), (None, 0, "user", "Yes."), (None, 4, "assistant", "No."),
             (8, None, "system", "One."), (8, None, "user", "Two.")]
    want = {c: brute([m for m in ms]) for c, ms in convs.items()}
    want[7] = brute([(" ", "Yes."), ("assistant", " ")])
    want[None] = brute([("user", "Yes."), ("assistant", "No.")])
    want[8] = brute([("system", "One."), ("user", "Two.")])
    got = {x.conv_id: x for x in C.repair(frame(spark, rows)).collect()}
    assert set(got) == set(want)
    messages = collections.defaultdict(list)
    for m in C.repaired_messages(frame(spark, rows)).orderBy("conv_id", "part", "at", "sub").collect():
        messages[m.conv_id].append((m.role, m.text))
    for c, (cost, audit, made) in want.items():
        assert (got[c].cost, got[c].audit) == (cost, audit), c
        assert got[c].repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()
        assert messages[c] == made
    assert (got[1].gaps, got[7].gaps, got[8].gaps, got[None].gaps) == (2, 0, 0, 3)


def test_a_conversation_with_a_third_of_all_rows_spans_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 64)
    r = random.Random(9)
    rows = [(1, t, r.choice(["user", "assistant"]), f"{r.randrange(300)} says {'.' if r.random() < 0.8 else ''}") for t in range(1500)]
    rows += [(c, t, ["user", "assistant"][t % 2], f"Turn {t}.") for c in range(2, 700) for t in range(4)]
    got = {x.conv_id: x for x in C.repair(frame(spark, rows, 8)).collect()}
    facts, _ = C.repaired([x[1:] for x in rows if x[0] == 1])
    assert {k: got[1][k] for k in facts if k != "sha"} == {k: v for k, v in facts.items() if k != "sha"}
    assert got[1].repaired_sha256 == facts["sha"] and len(got) == 699 and got[500].audit == "KKKK" and got[500].cost == 0


def test_gone_rows_and_empty_table(spark):
    rows = frame(spark, [(1, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")])
    got = {x.conv_id: x for x in C.repair(rows, gone=F.col("conv_id") == 1).collect()}
    assert got[1].audit == "" and got[1].cost == 0 and got[1].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].audit == "KK"
    assert C.repair(frame(spark, [])).count() == 0 and C.repaired_messages(frame(spark, [])).count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = collections.defaultdict(list)
    for x in damaged(frame(spark, rows)).collect():
        got[x.conv_id, x.turn].append((x.role, x.text, x.gone))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = {1: [(role, "", False)], 2: [(role, text.replace(".", "").replace("!", ""), False)], 3: [(role, text, False)] * 2,
                4: [("user", text, False)]}.get(kind, [(role, text, kind == 0)])
        assert got[c, t] == want


def test_query_on_the_fixture(spark):
    import duckdb

    from docshelf.llm.queries import ORACLE, load_all

    from ..conftest import SF_SMALL

    load_all()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF_SMALL}/conversations.parquet')")
    got = sorted(map(tuple, op11_conversation_repair(spark, SF_SMALL).collect()))
    assert got == sorted(con.sql(ORACLE["op11_conversation_repair"]).fetchall())
