import hashlib
import itertools
import random
import re
import zlib

import pytest
from llm_data import SF
from pyspark.sql import functions as F

from lurescan.llm import conversations

OK = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def best(letters):
    """(cost, audit) by plain rounds over all states, for the pattern letters of the operator."""
    after = conversations.AFTER

    def inserts(labels):
        for _ in range(4):
            for (q, c), to in after.items():
                if c in "ua" and q in labels:
                    cost, audit = labels[q]
                    labels[to] = min(labels.get(to, (99999, "")), (cost + 2, audit + "I"))
        return labels

    labels = inserts({0: (0, "")})
    for r in letters:
        new = {}

        def put(to, label, new=new):
            new[to] = min(new.get(to, (99999, "")), label)

        for q, (cost, audit) in labels.items():
            put(q, (cost + 3, audit + "D"))
            if r == "d":
                continue
            for (p, c), to in after.items():
                if p == q:
                    if c == r.lower():
                        put(to, (cost + r.isupper(), audit + "K"))
                    if c in "ua":
                        put(to, (cost + 2 + r.isupper(), audit + "R"))
        labels = inserts(new)
    return min(labels[q] for q in (0, 3) if q in labels)


def exhaustive(letters):
    """The same by trying every edit list with at most three insertions a place."""
    found = []

    def go(i, roles, cost, audit, free):
        if i == len(letters) and OK.fullmatch(roles):
            found.append((cost, audit))
        if free:
            for c in "ua":
                go(i, roles + c, cost + 2, audit + "I", free - 1)
        if i < len(letters):
            r = letters[i]
            go(i + 1, roles, cost + 3, audit + "D", 3)
            if r != "d":
                if r.lower() in "sua":
                    go(i + 1, roles + r.lower(), cost + r.isupper(), audit + "K", 3)
                for c in "ua":
                    go(i + 1, roles + c, cost + 2 + r.isupper(), audit + "R", 3)

    go(0, "", 0, "", 3)
    return min(found)


def brute(rows):
    """{conv_id: result} of damaged rows (conv_id, turn, role, text, dropped)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r, x) for c, t, r, x, gone in rows if c == conv and not gone))
        seen, letters, faults = set(), [], []
        for _, _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            c = role[0] if role[:1] in tuple("sua") else "x"
            letters.append("d" if fault in ("blank", "duplicate") else c.upper() if fault else c)
            faults.append(fault)
        cost, audit = best(letters)
        lines, at, state = [], 0, 0
        for e in audit:
            if e != "D":
                role = own[at][2] if e == "K" else ("assistant" if state == 2 else "user")
                state = conversations.AFTER[state, role[0]]
                lines.append(f"{role}:{'' if e == 'I' else own[at][3]}")
            at += e != "I"
        turns = [t for ok, t, _, _ in own if ok]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def damaged(rows):
    """The contract's damage in plain Python."""
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = "user" if kind == 4 else " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, r, x, kind == 0)] * (2 if kind == 3 else 1)
    return out


def test_search_equals_both_brute_forces():
    rng = random.Random(1)
    for n in range(3):
        for letters in itertools.product("suaxSUAXd", repeat=n):
            assert conversations.cheapest("".join(letters)) == best(letters) == exhaustive(letters)
    for _ in range(40):
        letters = "".join(rng.choice("suaxSUAd") for _ in range(3))
        assert best(letters) == exhaustive(letters)
    for _ in range(2000):
        letters = "".join(rng.choice(rng.choice(["suaxSUAXd", "ua", "uad", "uuaaS"])) for _ in range(rng.randrange(40)))
        assert conversations.cheapest(letters) == best(letters)


def test_composed_segments_equal_the_whole():
    rng = random.Random(2)
    for _ in range(300):
        letters = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randrange(60)))
        composed, at, parts = conversations.Composition(), 0, []
        while at < len(letters) or not parts:
            n = rng.randrange(0, 9)
            parts.append(letters[at:at + n])
            composed.add(conversations.table(parts[-1]))
            at += n
        cost, audit, path = composed.end()
        assert (cost, audit) == best(letters)
        assert path[0][0] == 0 and path[-1][1] in (0, 3) and all(a[1] == b[0] for a, b in zip(path, path[1:]))
        assert "".join(dict(((a, b), x) for a, b, _, x in conversations.table(p))[e] for p, e in zip(parts, path)) == audit


def test_table_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    want = brute(damaged([tuple(r) for r in df.collect()]))
    assert got(conversations.repair(conversations.damage(df), dropped="dropped")) == want


ODD = [
    (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi!"), (2, 0, None, "x."), (2, 1, "user", None), (2, None, "system", "Be kind."),
    (3, 5, "user", "a."), (3, 5, "user", "a."), (3, 5, "assistant", "b"), (3, 5, "assistant", "a?"), (3, 9, "", "c."),
    (None, 1, "user", "Who?"), (None, None, None, None), (4, 1, "user", "x" * 50_000 + "."), (4, 2, "assistant", "é 漢字 \n\t. "),
    (5, 1, "ugly", "one."), (5, 2, "tool", "two."), (5, -7, "assistant", " \x0b"), (6, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "x", 1, True) for r in ODD]
    return spark.createDataFrame(rows, SCHEMA + ", own string, part int, whole boolean").repartition(3)


def plain(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x, False) for c, t, r, x in rows]


def test_odd_rows(odd):
    assert got(conversations.repair(odd)) == brute(plain(ODD))
    assert got(conversations.repair(conversations.damage(odd.select("conv_id", "turn", "role", "text")), dropped="dropped")) == brute(damaged(ODD))


def test_empty_table_and_dropped_conversations(odd):
    assert conversations.repair(odd.limit(0)).count() == 0
    gone = conversations.repair(odd.withColumn("gone", F.lit(True)), dropped="gone")
    assert set(got(gone).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("segment", [3, 256])
def test_long_conversations_are_cut(spark, monkeypatch, segment):
    """One conversation of most rows, equal rows in many, over several partitions and segments."""
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    rng = random.Random(3)
    rows = [(7, rng.randrange(400), rng.choice(["user", "assistant", "assistant", "tool"]),
             rng.choice(["ok.", f"text {i}.", f"text {i}", "", "Yes!"])) for i in range(700)]
    rows += [(8, 1, "user", "same.")] * 300 + [(9, i, "ua"[i % 2] + "x", f"{i}.") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(conversations.repair(df)) == brute(plain(rows))
    turns = {}
    for r in conversations.repair(df, with_rows=True).collect():
        turns.setdefault(r.conv_id, []).append(((r.part, r.seq), [(x.role, x.text) for x in r.rows]))
    for conv, own in turns.items():
        lines = [f"{a}:{b}" for _, part in sorted(own) for a, b in part]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == brute(plain(rows))[conv][-1]
        assert OK.fullmatch("".join(x[0] for x in lines))
