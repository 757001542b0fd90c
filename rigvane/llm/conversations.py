"""Repair of the structure of conversations at least cost.

A conversation's turns must read, by role initials, `(s?(ua)+)?`.  Turns may be kept (K, cost 0), given the role user or
assistant (R, 3) or deleted (D, 4); turns with an empty text may be inserted anywhere (I, 3).  Blank turns and turns whose role
and text were seen before must go; a truncated turn that stays adds 3.  Of the cheapest repairs the one whose edits read
least in ASCII is taken.  After given edits the grammar leaves one choice of role, so the edits say everything.

Method: conversations are dealt to tasks by the hash of their id and sorted there by Spark; a task works on blocks of BLOCK_ROWS turns.
In a block, one recursive DuckDB query advances all conversations by one turn in each recursion and keeps for each grammar
state (nothing yet, s, u, a) the least cost and its edits.  A longer conversation is cut into lanes of LANE turns that are advanced side by
side from every state they may begin in, and the lanes are chained afterwards, also from block to block.  Two ways to one state
with one cost never have edits of which one begins with the other (the longer one would have inserted more, and cost more),
so keeping the least of them is exact.  What is carried is, for each of four states, a cost, the edits, and a running digest of the
turns so far: of a conversation of any length a task holds one block of turns and its result's edits.  A digest is made in order, so one
conversation's turns go through one task, one block after another.

Defined results: a null id is one conversation; null turns come first; turns that agree in number are ordered by role and then text; null role and
text are one space; an initial other than s, u, a (or none) is illegal and cannot be kept; a conversation without turns has zeros, no edits and the digest of
the empty string; gaps that exceed 64 bits wrap around; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, read

BLANKS = " \t\n\x0b\f\r"
BLOCK_ROWS, BLOCK_BYTES, LANE = 4096, 1 << 23, 64

# Grammar: 0 nothing yet, 1 after s, 2 after u, 3 after a.  What each initial (1 s, 2 u, 3 a) leads to.
STEP = {0: {1: 1, 2: 2}, 1: {2: 2}, 2: {3: 3}, 3: {2: 2}}
#: The initial that an inserted or renamed turn gets in each state, and what is inserted at the end of a conversation.
FORCED = {0: 2, 1: 2, 2: 3, 3: 2}
ENDING = {0: "", 1: "II", 2: "I", 3: ""}
ROLE = {2: "user", 3: "assistant"}
KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

Way = tuple[int, str, "hashlib._Hash"]


def moves() -> pa.Table:
    """Every way over one turn: insertions before it (two at most, as a third only comes back), then its edit."""
    rows = []
    for state in STEP:
        before, cost, at = "", 0, state
        for _ in range(3):
            rows.append((state, at, DELETE + cost, before + "D", 0, False))
            rows += [(state, to, KEEP + cost, before + "K", initial, True) for initial, to in STEP[at].items()]
            rows.append((state, STEP[at][FORCED[at]], RENAME + cost, before + "R", 0, True))
            before, cost, at = before + "I", cost + INSERT, STEP[at][FORCED[at]]
    names = ["from_state", "to_state", "cost", "letters", "initial", "stays"]
    return pa.table(dict(zip(names, (list(c) for c in zip(*rows)))))


#: One recursion advances every lane by one turn.
WALK = f"""WITH RECURSIVE walk(lane, pos, start, state, best) AS (
 SELECT lane, 0, start, start, {{'cost': 0, 'edits': ''}} FROM starts
 UNION ALL
 SELECT w.lane, w.pos + 1, w.start, m.to_state, min({{'cost': w.best.cost + m.cost + CASE WHEN m.stays AND t.truncated THEN {TRUNCATED} ELSE 0 END, 'edits': w.best.edits || m.letters}})
 FROM walk w JOIN turns t ON t.lane = w.lane AND t.pos = w.pos + 1 JOIN moves m ON m.from_state = w.state AND (NOT m.stays OR NOT t.doomed) AND m.initial IN (0, t.initial)
 GROUP BY w.lane, w.pos, w.start, m.to_state)
 SELECT w.lane, w.start, w.state, w.best.cost, w.best.edits FROM walk w JOIN (SELECT lane, max(pos) AS pos FROM turns GROUP BY lane) e USING (lane, pos) ORDER BY w.lane"""


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, alive) with the faults that crc32 of `conv:turn` decides; a dropped row stays as one that is not alive."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn)).cast("binary")) % 20
    said = F.when(fault <= 1, "").when(fault == 2, F.regexp_replace(filled(text), "[.!?]", "")).otherwise(filled(text))
    who = F.when(fault == 4, "user").otherwise(filled(role))
    times = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = rows.select(F.col(conv), F.col(turn), who.alias("role"), said.alias("text"), (fault != 0).alias("alive"), F.explode(times).alias("copy"))
    return out.toDF(conv, turn, role, text, "alive", "copy").drop("copy")


def faults(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", alive: str | None = None) -> DataFrame:
    """(id, turn, role, text, alive, fault, initial), dealt out by conversation and in its order; fault: 0 none, 1 blank, 2 seen before, 3 truncated.

    Turns seen before are found by a sort of a conversation's turns in the same task, which spills; nothing is dealt out twice."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    here = F.col(alive) if alive else F.lit(True)
    rows = rows.select(F.col(conv).alias("id"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), here.alias("alive"))
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    # Of rows that agree in all but place, the one that is not marked comes first.
    again = F.row_number().over(Window.partitionBy("id", "alive", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    initial = F.coalesce(*[F.when(F.col("role").startswith(c), F.lit(i)) for i, c in ((1, "s"), (2, "u"), (3, "a"))], F.lit(0))
    fault = F.when(~F.col("alive"), 0).when(end == "", 1).when(again, 2).when(~end.isin(".", "!", "?"), 3).otherwise(0)
    return rows.repartition("id").withColumn("fault", fault.cast("int")).withColumn("initial", initial.cast("int")).sortWithinPartitions(F.asc_nulls_first("id"), F.asc_nulls_first("turn"), "role", "text", F.col("fault") == 2)


class Open:
    """A conversation whose end has not been seen: counts, and for each grammar state the best way to it."""

    def __init__(self, key: object):
        self.key, self.n = key, [0, 0, 0]
        self.illegal, self.last, self.turns = 0, None, None
        self.ways: dict[int, Way] = {0: (0, "", hashlib.sha256())}

    def count(self, turns: list, fault: np.ndarray, initial: np.ndarray) -> None:
        for k in range(3):
            self.n[k] += int((fault == k + 1).sum())
        before = initial[:-1] if self.last is None else np.concatenate([[self.last], initial[:-1]])
        pair = before * 4 + (initial[1:] if self.last is None else initial)
        self.illegal += int((~np.isin(pair, (1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2))).sum())
        self.last = int(initial[-1])
        if known := [t for t in turns if t is not None]:
            distinct = 1 + sum(a != b for a, b in zip(known, known[1:]))
            low, high, n = self.turns or (known[0], known[0] - 1, 0)
            self.turns = (low, known[-1], n + distinct - (high == known[0] and n > 0))

    def gaps(self) -> int:
        if self.turns is None:
            return 0
        low, high, n = self.turns
        return (high - low + 1 - n + (1 << 63)) % (1 << 64) - (1 << 63)

    def advance(self, found: list[tuple[int, int, int, str]], roles: list[str], texts: list[str], last: bool) -> None:
        """Goes over a lane of turns by its best ways (start, state, cost, edits); if it is the last one, only the way that ends best is followed."""
        best: dict[int, tuple[int, str, int, str]] = {}
        for start, state, cost, edits in found:
            if start in self.ways:
                way = (self.ways[start][0] + cost, self.ways[start][1] + edits, start, edits)
                if state not in best or way[:2] < best[state][:2]:
                    best[state] = way
        if last:
            state = min(best, key=lambda s: (best[s][0] + INSERT * len(ENDING[s]), best[s][1] + ENDING[s]))
            best = {state: best[state]}
        self.ways = {state: (cost, edits, written(self.ways[start][2].copy(), start, new, roles, texts)) for state, (cost, edits, start, new) in best.items()}

    def row(self) -> tuple:
        state = min(self.ways, key=lambda s: (self.ways[s][0] + INSERT * len(ENDING[s]), self.ways[s][1] + ENDING[s]))
        cost, edits, digest = self.ways[state]
        digest = written(digest.copy(), state, ENDING[state], [], [])
        return (self.key, self.gaps(), *self.n, self.illegal, cost + INSERT * len(ENDING[state]), edits + ENDING[state], digest.hexdigest())


def written(digest: "hashlib._Hash", state: int, edits: str, roles: list[str], texts: list[str]) -> "hashlib._Hash":
    """The digest after the turns that these edits leave, from a grammar state on."""
    out, at = [], 0
    for e in edits:
        if e != "D":
            initial = "?sua".index(roles[at][0]) if e == "K" else FORCED[state]
            who = roles[at] if e == "K" else ROLE[initial]
            out.append(f"{chr(10) if state else ''}{who}:{'' if e == 'I' else texts[at]}")
            state = STEP[state][initial]
        at += e != "I"
    digest.update("".join(out).encode())
    return digest


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", alive: str | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation; rows that are not `alive` only say that it exists."""
    ready = faults(rows, conv, turn, role, text, alive)
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([T.StructField(conv, ready.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        con.register("moves", moves())
        current: Open | None = None
        for block, last in blocks(batches):
            done, current = advance(con, block, current)
            done += [current.row()] if last and current else []
            if done:
                cols = list(zip(*done))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], block.schema[0].type), *(pa.array(c, pa.int64()) for c in cols[1:7]), *(pa.array(c, pa.string()) for c in cols[7:])], schema.names)

    return in_arrow(ready, run, schema)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Batches put together to blocks, each with whether it is the last one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            if held and (sum(b.num_rows for b in held) >= BLOCK_ROWS or sum(b.nbytes for b in held) >= BLOCK_BYTES):
                yield pa.Table.from_batches(held), False
                held = []
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held), True


def advance(con: "duckdb.DuckDBPyConnection", block: pa.Table, current: Open | None) -> tuple[list[tuple], Open]:
    """The rows of conversations that end in the block, and the one that is still open, after `current` from the block before."""
    block = block.combine_chunks()
    ids = block.column("id")
    same = pc.or_kleene(pc.equal(ids[1:], ids[:-1]), pc.and_(pc.is_null(ids[1:]), pc.is_null(ids[:-1])))
    head = np.concatenate([[True], ~same.fill_null(False).to_numpy().astype(bool)])
    first = np.append(np.flatnonzero(head), len(head))
    alive = block.column("alive").to_numpy()
    fault, initial = block.column("fault").to_numpy(), block.column("initial").to_numpy()
    turns, roles, texts = (block.column(c).to_pylist() for c in ("turn", "role", "text"))
    spans, lane, pos, starts = [], np.full(len(head), -1), np.zeros(len(head), np.int64), []
    for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
        at = a + np.flatnonzero(alive[a:b])
        begins = {0} if k or current is None or current.key != ids[int(a)].as_py() else set(current.ways)
        cuts = []
        for i in range(0, len(at), LANE):
            part = at[i : i + LANE]
            n = len(starts)
            lane[part], pos[part] = n, np.arange(1, len(part) + 1)
            starts.append((n, begins if i == 0 else set(STEP)))
            cuts.append((n, part))
        spans.append((int(a), at, cuts))
    on = lane >= 0
    con.register("turns", pa.table({"lane": lane[on], "pos": pos[on], "initial": initial[on].astype(np.int64), "doomed": np.isin(fault[on], (1, 2)), "truncated": fault[on] == 3}))
    con.register("starts", pa.table({"lane": pa.array([n for n, s in starts for _ in s], pa.int64()), "start": pa.array([x for _, s in starts for x in s], pa.int64())}))
    found: dict[int, list] = {n: [] for n, _ in starts}
    for n, *way in con.execute(WALK).fetchall() if starts else []:
        found[n].append(tuple(way))
    done: list[tuple] = []
    for k, (a, at, cuts) in enumerate(spans):
        key = ids[a].as_py()
        if k or current is None or current.key != key:
            done += [current.row()] if current else []
            current = Open(key)
        if len(at):
            current.count([turns[i] for i in at], fault[at], initial[at])
        for j, (n, part) in enumerate(cuts):
            current.advance(found[n], [roles[i] for i in part], [texts[i] for i in part], k + 1 < len(spans) and j + 1 == len(cuts))
    return done, current


#: The same rows in one recursive query over all conversations; crc32 by its table, roles of repaired turns by their place.
SQL = r"""WITH RECURSIVE tbl AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
 src AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS x FROM conversations, tbl),
 dam AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE WHEN x = 1 THEN '' WHEN x = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(CASE WHEN x = 3 THEN [1, 2] ELSE [1] END) AS copy FROM src WHERE x <> 0),
 num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS c, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail FROM dam),
 f AS (SELECT *, CASE WHEN tail = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN tail NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM num),
 st AS (SELECT conv_id, CAST(CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND p || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
 nxt AS (SELECT * FROM (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')) v(q, c, z)),
 ins AS (SELECT * FROM (VALUES ('', '', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''), ('', 'u', 3, 'I'), ('s', 'u', 3, 'I'), ('u', 'a', 3, 'I'), ('a', 'u', 3, 'I'), ('', 'a', 6, 'II'), ('s', 'a', 6, 'II')) v(q, z, k, e)),
 mv AS (SELECT q, z, k + 4 AS k, e || 'D' AS e, NULL AS c FROM ins UNION ALL SELECT ins.q, nxt.z, k, e || 'K', nxt.c FROM ins JOIN nxt ON nxt.q = ins.z UNION ALL SELECT ins.q, nxt.z, k + 3, e || 'R', NULL FROM ins JOIN nxt ON nxt.q = ins.z WHERE nxt.c <> 's'),
 w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS q, {'k': 0, 'e': ''} AS best FROM st
  UNION ALL SELECT w.conv_id, w.i + 1, mv.z, min({'k': w.best.k + mv.k + CASE WHEN fault = 't' AND NOT ends_with(mv.e, 'D') THEN 3 ELSE 0 END, 'e': w.best.e || mv.e}) FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN mv ON mv.q = w.q AND (ends_with(mv.e, 'D') OR fault NOT IN ('b', 'd')) AND (mv.c IS NULL OR mv.c = f.c) GROUP BY w.conv_id, w.i, mv.z),
 fin AS (SELECT st.conv_id, min({'k': w.best.k + ins.k, 'e': w.best.e || ins.e}) AS best FROM st JOIN w ON st.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = st.n JOIN ins ON ins.q = w.q AND ins.z IN ('', 'a') GROUP BY st.conv_id),
 let AS (SELECT conv_id, unnest(string_split(best.e, '')) AS e, unnest(range(length(best.e))) AS j FROM fin WHERE best.e <> ''),
 row_of AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i FROM let),
 stay AS (SELECT row_of.conv_id, j, e, f.role, f.text, row_number() OVER (PARTITION BY row_of.conv_id ORDER BY j) AS o, first(f.c) OVER (PARTITION BY row_of.conv_id ORDER BY j) = 's' AND first(e) OVER (PARTITION BY row_of.conv_id ORDER BY j) = 'K' AS sys FROM row_of LEFT JOIN f ON row_of.conv_id IS NOT DISTINCT FROM f.conv_id AND row_of.i = f.i AND e <> 'I' WHERE e <> 'D'),
 txt AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - CASE WHEN coalesce(sys, false) THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS t FROM stay GROUP BY conv_id),
 al AS (SELECT DISTINCT conv_id FROM conversations)
 SELECT al.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.k, 0) AS BIGINT) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(txt.t, '')) AS repaired_sha256
 FROM al LEFT JOIN st ON al.conv_id IS NOT DISTINCT FROM st.conv_id LEFT JOIN fin ON al.conv_id IS NOT DISTINCT FROM fin.conv_id LEFT JOIN txt ON al.conv_id IS NOT DISTINCT FROM txt.conv_id"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(read(spark, sf_dir, "conversations")), alive="alive")
