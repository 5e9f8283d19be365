"""Operator 12: conversation structure repair by bidirectional Dijkstra over an edit lattice.

A repaired conversation's roles read ``(s?(ua)+)?`` by their initials.  Edits,
in the order of the rows: Keep costs 0, Rerole to user or assistant 2, Delete 3
(required for blank and duplicate rows), Insert an empty user or assistant row
2; a truncated row that is not deleted adds 1.  Of the cheapest edit lists the
one whose initials (the audit) are least in ASCII order is taken.

The lattice has a node for every number of rows consumed and every last role
(none, s, u, a).  One heap grows labels from the start, one from the accepting
ends; both settle nodes by (cost, rows consumed from their own end), so each
settled label has the least audit of its cost.  The search goes on while the
two fronts' least costs add up to no more than the best crossing, so that all
crossings of equal cost are finished, and then the least concatenated audit is
picked.  At one node, two equally cheap audits are never prefixes of each
other (they would differ by insertions, which cost), so least parts make least
wholes.

On Spark: rows are range-partitioned by (conversation, turn, role, text) and
read in order, once, texts included.  A conversation that lies inside one
partition and within ``SEGMENT`` rows and ``SEGMENT_BYTES`` is solved there.
Any other is cut into segments of that size: repeats are found by the first
place of every (conversation, row digest), each segment gets the cheapest
(cost, audit) from every entry state to every exit state by the same search,
a scan over the segments composes them, and the repaired text is hashed in
order.  So a conversation of any length is spread over tasks; what stays in
order in one task are one small row a segment and the hash of its text, which
is sequential by definition.  Both ways give the same result.

Cases
-----
* null role or text: one space, hence an illegal role, a blank text.
* null conv_id: a conversation of its own.  Null turns come first and do not count for gaps.
* equal turns: ordered by role, then text; equal rows by nothing, as they are the same.
* repeated rows: duplicates from the second on.
* a role that does not begin with s, u or a (also the empty one) cannot be kept.
* conversations whose rows are all dropped: zeros, empty audit, the hash of the empty string.
* very long texts: a segment holds one row at least.
* empty table: an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lurescan.llm import common

SEGMENT = 256
SEGMENT_BYTES = 4 << 20
ROLE_PREFIX, TEXT_PREFIX = 32, 128
WHITE = " \t\n\x0b\x0c\r"
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: state that a role's initial leads to
AFTER = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (NONE, ASSISTANT)
FAR = 1 << 60


# -- the lattice of one segment: a letter a row (s, u, a, x: any other role; capital: truncated; d: to be deleted)

def _moves(row: str) -> list[tuple[int, int, int, str]]:
    """(from state, to state, cost, initial) of the edits that consume the row."""
    out = [(q, q, 3, "D") for q in range(4)]
    if row != "d":
        more = row.isupper()
        out += [(q, to, int(more), "K") for (q, c), to in AFTER.items() if c == row.lower()]
        out += [(q, to, 2 + more, "R") for (q, c), to in AFTER.items() if c in "ua"]
    return out


INSERTS = [(q, to, 2, "I") for (q, c), to in AFTER.items() if c in "ua"]
_ROWS = "suaxSUAXd"
FORWARD = {r: [[(to, w, e) for q, to, w, e in _moves(r) if q == s] for s in range(4)] for r in _ROWS}
BACKWARD = {r: [[(q, w, e) for q, to, w, e in _moves(r) if to == s] for s in range(4)] for r in _ROWS}
INSERT_TO = [[(to, w, e) for q, to, w, e in INSERTS if q == s] for s in range(4)]
INSERT_FROM = [[(q, w, e) for q, to, w, e in INSERTS if to == s] for s in range(4)]


class _Front:
    """Labels (cost, audit) of one direction, its heap and its settled nodes; nodes are 4 * row + state."""

    def __init__(self, nodes):
        self.label = {v: (0, "") for v in nodes}
        self.heap = [(0, 0, v) for v in nodes]
        self.settled: set[int] = set()

    def least(self) -> int:
        while self.heap and self.heap[0][2] in self.settled:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else FAR


@lru_cache(maxsize=1 << 15)
def cheapest(rows: str, start: int = NONE, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from a state before the rows to one of the states behind them."""
    n = len(rows)
    ahead, back = _Front([start]), _Front([4 * n + q for q in ends])
    best = 0 if any(q == start for q in ends) and not n else FAR
    while (f := ahead.least()) + (b := back.least()) <= best and f < FAR and b < FAR:
        forward = f <= b
        side, other = (ahead, back) if forward else (back, ahead)
        cost, _, node = heappop(side.heap)
        side.settled.add(node)
        audit = side.label[node][1]
        i, q = divmod(node, 4)
        if forward:
            steps = [(4 * i + to, w, audit + e) for to, w, e in INSERT_TO[q]]
            if i < n:
                steps += [(4 * i + 4 + to, w, audit + e) for to, w, e in FORWARD[rows[i]][q]]
        else:
            steps = [(4 * i + to, w, e + audit) for to, w, e in INSERT_FROM[q]]
            if i:
                steps += [(4 * i - 4 + to, w, e + audit) for to, w, e in BACKWARD[rows[i - 1]][q]]
        for to, w, text in steps:
            if to in side.settled:
                continue
            new, old = (cost + w, text), side.label.get(to)
            if old is None or new < old:
                side.label[to] = new
                if old is None or new[0] < old[0]:
                    heappush(side.heap, (new[0], to // 4 if forward else n - to // 4, to))
                if (met := other.label.get(to)) is not None:
                    best = min(best, new[0] + met[0])
    if best == FAR:
        return None
    small, large = (ahead.label, back.label) if len(ahead.label) < len(back.label) else (back.label, ahead.label)
    crossings = [v for v in small if v in large and small[v][0] + large[v][0] == best]
    return best, min(ahead.label[v][1] + back.label[v][1] for v in crossings)


def table(rows: str) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) for every pair of states that the rows can connect."""
    return [(a, b, *got) for a in range(4) for b in range(4) if (got := cheapest(rows, a, (b,))) is not None]


class Composition:
    """Cheapest labels behind the segments read so far, without keeping a whole audit a state.

    What all states' audits begin with is final and moved to ``done``; the rest
    stays as a tail a state, which is all that comparing them needs.
    """

    def __init__(self):
        self.labels = {NONE: (0, "")}
        self.done: list[str] = []
        self.back: list[dict[int, int]] = []  # a segment: exit -> entry

    def add(self, rows: list[tuple[int, int, int, str]]) -> None:
        new, back = {}, {}
        for entry, exit_, cost, audit in rows:
            if entry in self.labels:
                have = self.labels[entry]
                got = have[0] + cost, have[1] + audit
                if exit_ not in new or got < new[exit_]:
                    new[exit_], back[exit_] = got, entry
        shared = len(commonprefix([a for _, a in new.values()]))
        if shared:
            self.done.append(next(iter(new.values()))[1][:shared])
        self.labels = {q: (c, a[shared:]) for q, (c, a) in new.items()}
        self.back.append(back)

    def end(self) -> tuple[int, str, list[tuple[int, int]]]:
        """Cost, audit, and (entry, exit) of every segment."""
        q = min((q for q in ENDS if q in self.labels), key=self.labels.__getitem__)
        cost, tail = self.labels[q]
        path = []
        for back in reversed(self.back):
            path.append((back[q], q))
            q = back[q]
        return cost, "".join(self.done) + tail, path[::-1]


# -- rows

def letter(role: str, text: str, repeated: bool) -> tuple[str, str]:
    """(the row's letter in the lattice, its fault or an empty string)."""
    bare = text.rstrip(WHITE)
    if not bare:
        return "d", "blank"
    if repeated:
        return "d", "duplicate"
    c = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return (c, "") if bare[-1] in ".!?" else (c.upper(), "truncated")


def repaired(roles: list[str], texts: list[str], audit: str, start: int = NONE) -> tuple[list[tuple[str, str]], int]:
    """The (role, text) rows that the edits give, and the state behind them."""
    out, at, state = [], 0, start
    for e in audit:
        if e == "D":
            at += 1
            continue
        if e == "K":
            role, text = roles[at], texts[at]
        else:  # the state decides the role
            role, text = "assistant" if state == USER else "user", "" if e == "I" else texts[at]
        at += e != "I"
        state = AFTER[state, role[0]]
        out.append((role, text))
    return out, state


def joined(rows: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{r}:{t}" for r, t in rows).encode("utf-8", "surrogatepass")


def illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def _gaps(turns: list[int]) -> int:
    return turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0


def solve(rows: list[tuple[int | None, str, str]]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, hash and rows of a whole conversation in order."""
    seen, letters, faults = set(), [], []
    for _, role, text in rows:
        c, fault = letter(role, text, (role, text) in seen)
        seen.add((role, text))
        letters.append(c)
        faults.append(fault)
    cost, audit = cheapest("".join(letters))
    roles, texts = [r for _, r, _ in rows], [t for _, _, t in rows]
    fixed, _ = repaired(roles, texts, audit)
    return (_gaps([t for t, _, _ in rows if t is not None]), faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), illegal(roles), cost, audit, hashlib.sha256(joined(fixed)).hexdigest(), fixed)


# -- Spark

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "array<struct<role:string,text:string>>"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``dropped``: rows damaged by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays with ``dropped``, to name its conversation), 1
    empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes
    it a user's.  Nulls count as one space.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _cut(batches: Iterator[pa.RecordBatch]):
    """(conversation, its rows in order, whether they are all of it) from a sorted partition."""
    rows, size, conv, fresh, first = [], 0, None, True, True
    for batch in batches:
        for c, turn, role, text, dropped in zip(*(col.to_pylist() for col in batch.columns)):
            if first or c != conv:
                if not first:
                    yield conv, rows, fresh
                    fresh = True  # only the first conversation may begin in the partition before
                else:
                    fresh = False
                rows, size, conv, first = [], 0, c, False
            elif rows and (len(rows) >= SEGMENT or size + len(text) > SEGMENT_BYTES):
                fresh = False
                yield conv, rows, False
                rows, size = [], 0
            if not dropped:
                rows.append((turn, role, text))
                size += len(text)
    if not first:
        yield conv, rows, False  # may go on in the next partition


def repair(df: DataFrame, dropped: str | None = None, with_rows: bool = False) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``df`` has conv_id, turn, role and text.  Rows whose column ``dropped`` is
    true only name their conversation.  With ``with_rows`` the result is
    ``(conv_id, part, seq, rows)`` instead: the repaired rows as arrays of
    (role, text), one array a segment, in the order of (part, seq).
    """
    spark = df.sparkSession
    common.ready(spark)
    key = df.schema["conv_id"].dataType.simpleString()
    space = F.lit(" ")
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
                     F.coalesce("text", space).alias("text"),
                     F.coalesce(F.col(dropped), F.lit(False)).alias("dropped") if dropped else F.lit(False).alias("dropped"))
    def first(batches):
        part, out = TaskContext.get().partitionId(), []
        for seq, (conv, own, whole) in enumerate(_cut(batches)):
            if whole:
                *result, fixed = solve(own)
                out.append((conv, part, seq, True, *result, [{"role": r, "text": t} for r, t in fixed] if with_rows else None, None))
            else:
                out.append((conv, part, seq, False, *[None] * 8, None, [{"turn": a, "role": r, "text": t} for a, r, t in own]))
            if len(out) >= 512 or not whole:
                yield _batch(out, arrow)
                out = []
        if out:
            yield _batch(out, arrow)

    schema = (f"conv_id {key}, part int, seq int, whole boolean, {RESULT}, fixed {ROWS}, "
              "own array<struct<turn:long,role:string,text:string>>")
    arrow = _arrow(spark, schema)
    solved = common.materialise(_ordered(rows).mapInArrow(first, schema), "conversations")
    pieces = solved.where("not whole").select("conv_id", "part", "seq", "own")
    summary, path = _compose(pieces, key)
    fixed = _fixed(pieces, path, key)
    if with_rows:
        return solved.where("whole").select("conv_id", "part", "seq", F.col("fixed").alias("rows")).unionByName(fixed)
    names = [f.split()[0] for f in RESULT.split(", ")]
    return solved.where("whole").select("conv_id", *names).unionByName(_hashed(summary, fixed, key).select("conv_id", *names))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in order of (conversation, turn, role, text), over range partitions that may cut a conversation anywhere.

    The partitions' key holds bounded prefixes, as its sample goes to the driver.
    Rows that the prefixes hold whole are also told apart by a number, as a
    third of all rows may be one and the same; longer ones stay together.
    """
    short = (F.length("role") <= ROLE_PREFIX) & (F.length("text") <= TEXT_PREFIX)
    keyed = rows.withColumn("number", F.when(short, F.monotonically_increasing_id()))
    return (keyed.repartitionByRange("conv_id", "turn", F.substring("role", 1, ROLE_PREFIX), F.substring("text", 1, TEXT_PREFIX), "number")
            .sortWithinPartitions("conv_id", "turn", "role", "text").drop("number"))


def _arrow(spark, ddl: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows), schema)], schema=schema)


def _compose(pieces: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(results of the cut conversations without their hash, the edits of each segment)."""
    spark = pieces.sparkSession
    # a row repeats if its conversation has it at an earlier place; the first places are written, so that
    # Spark can split the join of a hot row
    marks = (pieces.select("conv_id", "part", "seq", F.posexplode("own").alias("at", "row"))
             .select("conv_id", F.struct("part", "seq", "at").alias("place"), "row.role", "row.text")
             .where(F.length(F.translate("text", WHITE, "")) > 0)
             .select("conv_id", "place", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
                     .alias("digest")))
    firsts = common.materialise(
        marks.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min("place").alias("f")), "first-places")
    repeats = (marks.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
               .where(F.col("place") > F.col("f")).groupBy("place.part", "place.seq").agg(F.collect_list("place.at").alias("again")))

    def tables(batches):
        for batch in batches:
            out = []
            for conv, part, seq, own, again in zip(*(col.to_pylist() for col in batch.columns)):
                again = set(again or ())
                got = [letter(r["role"], r["text"], i in again) for i, r in enumerate(own)]
                faults = [f for _, f in got]
                turns = [r["turn"] for r in own if r["turn"] is not None]
                roles = [r["role"] for r in own]
                out.append((conv, part, seq, len(own), *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal(roles),
                            roles[0][:1] if own else None, roles[-1][:1] if own else None,
                            turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)),
                            [dict(zip(("entry", "exit", "cost", "audit"), x)) for x in table("".join(c for c, _ in got))]))
            if out:
                yield _batch(out, small)

    schema = (f"conv_id {key}, part int, seq int, n int, blank long, duplicate long, truncated long, illegal long, "
              "head string, tail string, low long, high long, turns long, paths array<struct<entry:int,exit:int,cost:long,audit:string>>")
    small = _arrow(spark, schema)
    segments = common.materialise(pieces.join(repeats, ["part", "seq"], "left").select("conv_id", "part", "seq", "own", "again")
                                  .mapInArrow(tables, schema), "segments")

    def scan(batches):
        def finish():
            cost, audit, path = composed.end()
            return (conv, high - low + 1 - turns if low is not None else 0, *counts, cost, audit,
                    [{"part": p, "seq": s, "entry": a, "exit": b} for (p, s), (a, b) in zip(places, path)])

        conv, started = None, False
        for batch in batches:
            for c, part, seq, n, *own, head, tail, a, b, k, paths in zip(*(col.to_pylist() for col in batch.columns)):
                if not started or c != conv:
                    if started:
                        yield _batch([finish()], ends)
                    conv, started = c, True
                    composed, counts, places, last = Composition(), [0, 0, 0, 0], [], None
                    low = high = None
                    turns = 0
                counts = [x + y for x, y in zip(counts, own)]
                if n:
                    counts[3] += last is not None and last + head not in ("su", "ua", "au")
                    last = tail
                if a is not None:
                    turns += k - (a == high)
                    low, high = a if low is None else low, b
                composed.add([(p["entry"], p["exit"], p["cost"], p["audit"]) for p in paths])
                places.append((part, seq))
        if started:
            yield _batch([finish()], ends)

    schema = (f"conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
              "path array<struct<part:int,seq:int,entry:int,exit:int>>")
    ends = _arrow(spark, schema)
    summary = common.materialise(segments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
                                 .mapInArrow(scan, schema), "composed")
    chosen = summary.select(F.explode("path").alias("p")).select("p.*")
    edits = (segments.select("part", "seq", F.explode("paths").alias("p")).select("part", "seq", "p.entry", "p.exit", "p.audit")
             .join(chosen, ["part", "seq", "entry", "exit"]).select("part", "seq", "entry", F.col("audit").alias("edits")))
    return summary.drop("path"), edits


def _fixed(pieces: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """conv_id, part, seq and the repaired rows of every segment of the cut conversations."""
    def run(batches):
        for batch in batches:
            for conv, part, seq, own, entry, audit in zip(*(col.to_pylist() for col in batch.columns)):
                rows, _ = repaired([r["role"] for r in own], [r["text"] for r in own], audit, entry)
                yield _batch([(conv, part, seq, [{"role": r, "text": t} for r, t in rows])], arrow)

    schema = f"conv_id {key}, part int, seq int, rows {ROWS}"
    arrow = _arrow(pieces.sparkSession, schema)
    return pieces.join(edits, ["part", "seq"]).select("conv_id", "part", "seq", "own", "entry", "edits").mapInArrow(run, schema)


def _hashed(summary: DataFrame, fixed: DataFrame, key: str) -> DataFrame:
    """The summary with the hash of each conversation's repaired rows, read segment by segment in order."""
    def run(batches):
        conv, sha, any_row = None, None, False
        for batch in batches:
            for c, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if sha is None or c != conv:
                    if sha is not None:
                        yield _batch([(conv, sha.hexdigest())], arrow)
                    conv, sha, any_row = c, hashlib.sha256(), False
                if rows:
                    sha.update(b"\n" * any_row + joined([(r["role"], r["text"]) for r in rows]))
                    any_row = True
        if sha is not None:
            yield _batch([(conv, sha.hexdigest())], arrow)

    schema = f"c {key}, repaired_sha256 string"
    arrow = _arrow(summary.sparkSession, schema)
    hashes = (fixed.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "rows")
              .mapInArrow(run, schema))
    return summary.join(hashes, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def query(spark, sf_dir) -> DataFrame:
    return repair(damage(common.documents(spark, sf_dir, "conversations")), dropped="dropped")


def _sql() -> str:
    """DuckDB twin: a label is eight digits of cost and the audit, so the least label is the cheapest, ties ASCII-least."""
    def step(state, cost, initial):
        return (f"CASE WHEN {state} IS NOT NULL THEN printf('%08d', CAST(left({state}, 8) AS INT) + {cost}) "
                f"|| substr({state}, 9) || '{initial}' END")

    def keep(state, role):
        return f"CASE WHEN lower(c) = '{role}' THEN {step(state, 'more', 'K')} END"

    def rerole(state):
        return f"CASE WHEN c <> 'd' THEN {step(state, '2 + more', 'R')} END"

    consumed = f"""
        SELECT conv_id, i, letters, {step('e', 3, 'D')} AS e, least({step('s', 3, 'D')}, {keep('e', 's')}) AS s,
          least({step('u', 3, 'D')}, {keep('e', 'u')}, {keep('s', 'u')}, {keep('a', 'u')}, {rerole('e')}, {rerole('s')}, {rerole('a')}) AS u,
          least({step('a', 3, 'D')}, {keep('u', 'a')}, {rerole('u')}) AS a
        FROM (SELECT *, letters[i + 1] AS c, CASE WHEN letters[i + 1] IN ('S', 'U', 'A', 'X') THEN 1 ELSE 0 END AS more
              FROM dp WHERE i < len(letters))"""
    inserted = f"SELECT conv_id, i, letters, e, s, least(u, {step('e', 2, 'I')}, {step('s', 2, 'I')}, {step('a', 2, 'I')}) AS u, a FROM ({consumed})"
    return rf"""
    WITH RECURSIVE bits AS (
      SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b))),
    raw AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(
          coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
      FROM conversations, bits),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
    marked AS (
      SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
        left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before FROM placed),
    coded AS (
      SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated'
        THEN CASE WHEN initial IN ('s', 'u', 'a') THEN upper(initial) ELSE 'X' END
        WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END AS c FROM marked),
    grouped AS (
      SELECT conv_id, list(c ORDER BY i) AS letters, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY conv_id),
    dp AS (
      SELECT conv_id, 0 AS i, letters, '00000000' AS e, CAST(NULL AS VARCHAR) AS s, '00000002I' AS u, '00000004II' AS a FROM grouped
      UNION ALL
      SELECT conv_id, i + 1, letters, e, s, u, least(a, {step('u', 2, 'I')}) FROM ({inserted})),
    done AS (SELECT conv_id, least(e, a) AS label FROM dp WHERE i = len(letters)),
    edits AS (
      SELECT conv_id, j, e, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS spot, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w AS pos
      FROM (SELECT conv_id, unnest(string_split(substr(label, 9), '')) AS e, unnest(range(length(label) - 8)) AS j
            FROM done WHERE length(label) > 8)
      WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
    parts AS (
      SELECT d.conv_id, j, pos, e, CASE WHEN e <> 'I' THEN roles[CAST(spot AS BIGINT)] END AS role,
        CASE WHEN e = 'I' THEN '' ELSE texts[CAST(spot AS BIGINT)] END AS text,
        max(CASE WHEN pos = 1 AND e = 'K' AND left(roles[CAST(spot AS BIGINT)], 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY d.conv_id) AS lead
      FROM edits d JOIN grouped g ON d.conv_id IS NOT DISTINCT FROM g.conv_id),
    lines AS (
      SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (pos - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || text, chr(10) ORDER BY j) AS body FROM parts WHERE e <> 'D' GROUP BY conv_id)
    SELECT o.conv_id, coalesce(g.gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(label, 8) AS BIGINT), 0) AS cost,
      coalesce(substr(label, 9), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN grouped g ON o.conv_id IS NOT DISTINCT FROM g.conv_id
    LEFT JOIN done d ON o.conv_id IS NOT DISTINCT FROM d.conv_id
    LEFT JOIN lines l ON o.conv_id IS NOT DISTINCT FROM l.conv_id"""


SQL = _sql()
