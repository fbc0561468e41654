"""Conversation structure repair: a square-root checkpointed DP over blocks of conversations' turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelark.llm.batches import whole_text_batches
from tracelark.llm.bloom import blocks_for, bloom_words, might_contain
from tracelark.llm.storage import Scratch, written

SPACE, STOPS = " \t\n\v\f\r", ".!?"
#: Costs of edits; a truncated turn that stays costs ``UNFINISHED`` more.
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
#: States: nothing yet, after the system's turn, after a user's, after an assistant's. Each has one turn that may be put there.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
AFTER_PUT = (USER, USER, ASSISTANT, USER)
PUT_ROLE = ("user", "user", "assistant", "user")
#: What it costs to end in each state: turns that are missing are put there.
AT_END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
#: A turn's code: the initial of its role (these, or 3), 4 if it is truncated, 8 if it must go.
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER, TRUNCATED, GOES = 3, 4, 8
LEGAL = ("su", "ua", "au")

FAULTS = "first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string"
BLOCKS = f"conv_id long, part int, seq int, {FAULTS}, costs array<long>, codes binary, runs array<long>, roles array<string>, texts array<string>"
WALKS = "conv_id long, part int, seq int, audits array<string>, states array<int>"
REPAIRED = f"conv_id long, part int, seq int, {FAULTS}, audit string, cost long, repaired array<struct<role: string, text: string>>"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _kept_state(state: int, initial: int) -> int | None:
    """The state after keeping a turn, or None where its role may not stand."""
    if initial == INITIALS["s"]:
        return SYSTEM if state == NOTHING else None
    if initial == INITIALS["u"]:
        return USER if state != USER else None
    return ASSISTANT if initial == INITIALS["a"] and state == USER else None


def _before(costs: list[int], code: int, run: int) -> list[int]:
    """Least costs from before a turn, by state, given those after it. Turns may be put in before it."""
    if code & GOES:
        own = [DELETE * run + c for c in costs]
    else:
        stay = UNFINISHED if code & TRUNCATED else 0
        own = []
        for state in range(4):
            least = min(DELETE + costs[state], REROLE + stay + costs[AFTER_PUT[state]])
            kept = _kept_state(state, code & 3)
            own.append(least if kept is None else min(least, stay + costs[kept]))
    user, assistant = min(own[USER], INSERT + own[ASSISTANT]), min(own[ASSISTANT], INSERT + own[USER])
    return [min(own[NOTHING], INSERT + user), min(own[SYSTEM], INSERT + user), user, assistant]


def block_costs(codes: bytes, runs: list[int]) -> list[int]:
    """Least costs from each state before a block (row by row) to each state after it."""
    columns = []
    for end in range(4):
        costs = [0 if state == end else FAR for state in range(4)]
        for code, run in zip(reversed(codes), reversed(runs), strict=True):
            costs = _before(costs, code, run)
        columns.append(costs)
    return [min(FAR, columns[end][state]) for state in range(4) for end in range(4)]


def tight_edits(codes: bytes, runs: list[int], after: list[int], starts: tuple[int, ...] = (NOTHING,), last: bool = True) -> list[tuple[str, int]]:
    """For each start state, the ASCII-least of the cheapest edits of a block's turns, and the state that they end in.

    ``after`` has the least costs by state from the end of the block on. Vectors of costs are kept only at every root of
    the number of turns; those between are computed again while walking forward, a stretch at a time.
    """
    n = len(codes)
    step = isqrt(n) + 1
    kept, costs = {n: list(after)}, list(after)
    for i in range(n - 1, -1, -1):
        costs = _before(costs, codes[i], runs[i])
        if i % step == 0:
            kept[i] = costs
    states, audits = list(starts), [[] for _ in starts]
    for low in range(0, n, step):
        high = min(n, low + step)
        stretch = [kept[high]]
        for i in range(high - 1, low - 1, -1):
            stretch.append(_before(stretch[-1], codes[i], runs[i]))
        for k, out in enumerate(audits):
            states[k] = _walk(codes, runs, low, high, stretch, states[k], out)
    for k, out in enumerate(audits if last else ()):
        while states[k] in (SYSTEM, USER):
            out.append("I")
            states[k] = AFTER_PUT[states[k]]
    return [("".join(out), state) for out, state in zip(audits, states, strict=True)]


def _walk(codes: bytes, runs: list[int], low: int, high: int, stretch: list[list[int]], state: int, out: list[str]) -> int:
    """Appends the least letters that stay on the cheapest way; ``stretch`` has the costs at ``high`` first, at ``low`` last."""
    for i in range(low, high):
        here, then, code = stretch[high - i], stretch[high - i - 1], codes[i]
        if code & GOES:
            out.append("D" * runs[i])
            continue
        stay = UNFINISHED if code & TRUNCATED else 0
        while here[state] != DELETE + then[state] and here[state] == INSERT + here[AFTER_PUT[state]]:
            out.append("I")
            state = AFTER_PUT[state]
        if here[state] == DELETE + then[state]:
            out.append("D")
            continue
        kept = _kept_state(state, code & 3)
        if kept is not None and here[state] == stay + then[kept]:
            out.append("K")
            state = kept
        else:
            out.append("R")
            state = AFTER_PUT[state]
    return state


def apply_edits(codes: bytes, runs: list[int], roles: list[str | None], texts: list[str | None], audit: str, state: int) -> tuple[list[dict], int]:
    """The turns that a block's edits leave, and what the edits cost."""
    out, cost, at = [], 0, 0

    def put(text: str) -> None:
        nonlocal state
        out.append({"role": PUT_ROLE[state], "text": text})
        state = AFTER_PUT[state]

    for i in range(len(codes) + 1):
        if i < len(codes) and codes[i] & GOES:
            at, cost = at + runs[i], cost + DELETE * runs[i]
            continue
        while audit[at : at + 1] == "I":
            put("")
            at, cost = at + 1, cost + INSERT
        if i == len(codes):
            break
        edit, stay = audit[at], UNFINISHED if codes[i] & TRUNCATED else 0
        at += 1
        if edit == "D":
            cost += DELETE
        elif edit == "R":
            put(texts[i])
            cost += REROLE + stay
        else:
            out.append({"role": roles[i], "text": texts[i]})
            state = _kept_state(state, codes[i] & 3)
            cost += stay
    return out, cost


class _Block:
    """Consecutive turns of one conversation."""

    def __init__(self, conv_id: int | None, part: int, seq: int):
        self.row = {"conv_id": conv_id, "part": part, "seq": seq, "first_turn": None, "last_turn": None, "head": None, "tail": None}
        self.row |= dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
        self.codes, self.runs, self.roles, self.texts, self.bytes = bytearray(), [], [], [], 0

    def add(self, turn: int | None, role: str, text: str, n: int, seen: bool) -> None:
        row, initial = self.row, role[:1]
        if row["head"] is None:
            row["head"] = initial
        else:
            row["illegal"] += row["tail"] + initial not in LEGAL
        row["illegal"] += n - 1
        row["tail"] = initial
        if turn is not None and turn != row["last_turn"]:
            row["turns"] += 1
            row["first_turn"], row["last_turn"] = turn if row["first_turn"] is None else row["first_turn"], turn
        said = text.rstrip(SPACE)
        if not said:
            row["blank"] += n
            self._goes(n)
        elif seen:
            row["duplicate"] += n
            self._goes(n)
        else:
            open_end = said[-1] not in STOPS
            row["truncated"] += open_end
            self._entry(INITIALS.get(initial, OTHER) | (TRUNCATED if open_end else 0), 1, role, text)
            if n > 1:
                row["duplicate"] += n - 1
                self._goes(n - 1)

    def _goes(self, n: int) -> None:
        if self.codes and self.codes[-1] & GOES:
            self.runs[-1] += n
        else:
            self._entry(GOES, n, None, None)

    def _entry(self, code: int, run: int, role: str | None, text: str | None) -> None:
        self.codes.append(code)
        self.runs.append(run)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text or "")

    def whole(self) -> dict:
        codes = bytes(self.codes)
        return self.row | {"costs": block_costs(codes, self.runs), "codes": codes, "runs": self.runs, "roles": self.roles, "texts": self.texts}


def _schema(ddl: str) -> pa.Schema:
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    named = [c.split(" ", 1) for c in ddl.replace("struct<role: string, text: string>", "turn").split(", ")]
    return pa.schema([(n, kinds.get(k, pa.list_(turn))) for n, k in named])


def _each(rows: Iterator[dict], ddl: str, most: int = 256) -> Iterator[pa.RecordBatch]:
    """Rows as batches: of ``most`` rows, or fewer where their texts are long."""
    schema, held, size = _schema(ddl), [], 0
    for row in rows:
        held.append(row)
        size += sum(len(t or "") for t in row.get("texts") or ())
        if len(held) >= most or size >= 1 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _cut(block_rows: int, block_bytes: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, seq, block, marked, last = TaskContext.get().partitionId(), 0, None, None, None
        for batch in batches:
            for conv_id, turn, role, text, sha, n, marker in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (conv_id, turn, role, sha)
                if marker:
                    marked = key
                    continue
                if block is None or conv_id != block.row["conv_id"] or len(block.codes) >= block_rows or block.bytes >= block_bytes:
                    if block:
                        yield block.whole()
                    block, seq = _Block(conv_id, part, seq), seq + 1
                block.add(turn, role, text, n, key in (marked, last))
                last = key
        if block:
            yield block.whole()

    return lambda batches: _each(blocks(batches), BLOCKS)


def _costs_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last block of a conversation first: the least costs by state after each block, from the costs of the blocks behind it."""
    conv_id, after = object(), list(AT_END)
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            last = row["conv_id"] != conv_id
            if last:
                conv_id, after = row["conv_id"], list(AT_END)
            rows.append({"part": row["part"], "seq": row["seq"], "after": after, "last": last})
            costs = row["costs"]
            after = [min(costs[4 * a + b] + after[b] for b in range(4)) for a in range(4)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("after", pa.list_(pa.int64())), ("last", pa.bool_())]))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                ways = tight_edits(row["codes"], row["runs"], row["after"], tuple(range(4)), row["last"])
                yield {c: row[c] for c in ("conv_id", "part", "seq")} | {"audits": [w[0] for w in ways], "states": [w[1] for w in ways]}

    return _each(rows(), WALKS)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first block of a conversation first: the state before each block, from how the blocks before it end."""
    conv_id, state = object(), NOTHING
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if row["conv_id"] != conv_id:
                conv_id, state = row["conv_id"], NOTHING
            rows.append({"part": row["part"], "seq": row["seq"], "start": state, "audit": row["audits"][state]})
            state = row["states"][state]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int32()), ("audit", pa.string())]))


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    same = [c.name for c in _schema(f"conv_id long, part int, seq int, {FAULTS}")]

    def rows() -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                turns, cost = apply_edits(row["codes"], row["runs"], row["roles"], row["texts"], row["audit"], row["start"])
                yield {c: row[c] for c in same} | {"audit": row["audit"], "cost": cost, "repaired": turns, "texts": [t["text"] for t in turns]}

    for batch in _each(rows(), f"{REPAIRED}, texts array<string>"):
        yield batch.drop_columns(["texts"])


def _sorted(df: DataFrame, descending: bool = False) -> DataFrame:
    """A conversation's blocks in one task, in order."""
    places = [F.col(c).desc() if descending else F.col(c) for c in ("part", "seq")]
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *places)


def repair(rows: DataFrame, block_rows: int = 1024, block_bytes: int = 1 << 20, often: int = 1000) -> DataFrame:
    """The cheapest edits of each conversation in ``rows`` (conv_id, turn, role, text), and the turns that they leave.

    Turns stand in order of turn, null first, then of role and of the text's SHA-256, so repeated rows are neighbours.
    The first fault of a turn counts: blank (nothing but white space), duplicate (its role and text stood earlier),
    truncated (doesn't end in a full stop, exclamation or question mark). Edits: Keep, Rerole to user or assistant (1),
    Delete (2; blank and duplicate turns must go), Insert an empty turn of a user or assistant (5); a truncated turn that
    stays costs 5. What is left has role initials ``(s?(ua)+)?``; of equally cheap edits those with the ASCII-least initials
    are taken.

    1. Which role and text stood earlier is found on hashes alone; repeats travel beside the rows as markers.
    2. Rows are dealt by ranges of their place, so a conversation may lie in many tasks; rows that occur ``often`` times
       alike are counted first. Each task cuts what it has of a conversation into blocks of ``block_rows`` turns (or
       ``block_bytes`` of text), and computes each block's costs from state to state (16 numbers).
    3. Those numbers, not the turns, meet by conversation: backward they give the vector of costs at each block's end,
       the checkpoints of the DP.
    4. Every block is walked on its own from each of the four states, with checkpoints at the root of its size; the ends
       of the walks, again by conversation, say which of them holds; its edits are applied to the block's turns.

    Null roles and texts are one space; any length of text is held one block at a time; a null conv_id is a conversation.
    Other columns are ignored; an empty table gives no rows.

    Returns a row a block: conv_id, part and seq (its order within the conversation), first_turn, last_turn and turns (the
    distinct numbers there, nulls apart), blank, duplicate, truncated and illegal (neighbours within the block other than
    su, ua, au), head and tail (the first and last initial), audit, cost and repaired (role, text).
    """
    spark = rows.sparkSession
    whole_text_batches(spark)
    scratch = Scratch(spark)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    keyed = rows.withColumn("sha", F.sha2("text", 256))
    place = ["conv_id", "turn", "role", "sha"]
    counts = scratch.written(keyed.groupBy(*place).agg(F.count("*").alias("n")), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    firsts = counts.groupBy("conv_id", "role", "sha").agg(F.min(order).alias("first"), F.count("*").alias("places")).where("places > 1")
    firsts = firsts.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("sha").alias("_sha"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("sha") == F.col("_sha"))
    again = counts.join(firsts, same).where(~order.eqNullSafe(F.col("first"))).select(*place)
    hot = scratch.written(counts.where(F.col("n") >= often).select(F.xxhash64(*place).alias("key")), "often")
    blocks = blocks_for(hot.count())
    tested = keyed.withColumn("_hot", might_contain(bloom_words(hot, blocks).scalar(), F.xxhash64(*place), blocks))
    shape = ["conv_id", "turn", "role", "text", "sha"]
    one = F.lit(1).cast("long").alias("n")
    calm = tested.where("not _hot").select(*shape, one)
    grouped = tested.where("_hot").groupBy(*shape).agg(F.count("*").alias("n"))
    turns = calm.unionByName(grouped).withColumn("marker", F.lit(False))
    markers = again.withColumn("text", F.lit("")).withColumn("n", one).withColumn("marker", F.lit(True))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.unionByName(markers).repartitionByRange(tasks, *place).sortWithinPartitions(*place, F.desc("marker"))
    cut = written(dealt.mapInArrow(_cut(block_rows, block_bytes), BLOCKS), "conversation-blocks")
    scratch.drop()

    at = ["part", "seq"]
    after = _sorted(cut.select("conv_id", *at, "costs"), descending=True).mapInArrow(_costs_after, "part int, seq int, after array<long>, last boolean")
    walks = cut.select("conv_id", *at, "codes", "runs").join(after, at).mapInArrow(_walked, WALKS)
    chosen = _sorted(walks).mapInArrow(_chosen, "part int, seq int, start int, audit string")
    return cut.drop("costs").join(chosen, at).mapInArrow(_applied, REPAIRED)


def report(repaired: DataFrame) -> DataFrame:
    """One row a conversation from the blocks of ``repair``: faults, cost, audit, and the SHA-256 of ``role:text`` lines.

    gaps counts the turn numbers missing between the least and the greatest. A hash of a whole conversation can't be
    composed, so its blocks pass in order through one task, which holds one of them and the audit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _each(_reported(row for batch in batches for row in batch.to_pylist()), REPORT)

    return _sorted(repaired).mapInArrow(run, REPORT)


def _reported(blocks: Iterator[dict]) -> Iterator[dict]:
    sums = ("turns", "blank", "duplicate", "truncated", "illegal", "cost")
    now: dict | None = None

    def whole() -> dict:
        gaps = now["last_turn"] - now["first_turn"] + 1 - now["turns"] if now["last_turn"] is not None else 0
        return {c: now[c] for c in ("conv_id", *sums[1:])} | {"gaps": gaps, "audit": "".join(now["audits"]), "repaired_sha256": now["hash"].hexdigest()}

    for block in blocks:
        if now is None or block["conv_id"] != now["conv_id"]:
            if now:
                yield whole()
            now = {"conv_id": block["conv_id"], "first_turn": None, "last_turn": None, "tail": None, "audits": [], "hash": hashlib.sha256(), "lines": 0}
            now |= dict.fromkeys(sums, 0)
        for c in sums:
            now[c] += block[c]
        if block["first_turn"] is not None:
            now["turns"] -= block["first_turn"] == now["last_turn"]
            now["first_turn"] = block["first_turn"] if now["first_turn"] is None else now["first_turn"]
            now["last_turn"] = block["last_turn"]
        now["illegal"] += now["tail"] is not None and now["tail"] + block["head"] not in LEGAL
        now["tail"] = block["tail"]
        now["audits"].append(block["audit"])
        for turn in block["repaired"]:
            now["hash"].update(f"{chr(10) if now['lines'] else ''}{turn['role']}:{turn['text']}".encode())
            now["lines"] += 1
    if now:
        yield whole()


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes its
    stops, 3 repeats it, 4 makes it a user's. Nulls are one space, here and in the key; a null turn stays null."""

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; those of which no row is left have empty results."""
    stored = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = report(repair(damaged(stored)))
    every = stored.select(F.col("conv_id").cast("long").alias("_conv")).distinct()
    joined = every.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select(F.col("_conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


ORACLE_SQL = r"""
WITH RECURSIVE
crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (
  SELECT keyed.*, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 20 AS kind FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
rows AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS is_open,
    left(role, 1) AS initial FROM placed),
faults AS (
  SELECT *, is_blank OR nth > 1 AS goes, NOT is_blank AND nth = 1 AND is_open AS truncated, CASE WHEN is_open THEN 5 ELSE 0 END AS stay FROM rows),
sizes AS (SELECT conv_id, count(*) AS n FROM faults GROUP BY conv_id),
back AS (
  SELECT conv_id, n AS i, 0::BIGINT AS v0, 10::BIGINT AS v1, 5::BIGINT AS v2, 0::BIGINT AS v3 FROM sizes
  UNION ALL
  SELECT conv_id, i - 1, least(c0, 5 + c2, 10 + c3), least(c1, 5 + c2, 10 + c3), least(c2, 5 + c3), least(c3, 5 + c2) FROM (
    SELECT b.conv_id, b.i,
      CASE WHEN goes THEN 2 + v0 ELSE least(2 + v0, 1 + stay + v2, CASE initial WHEN 's' THEN stay + v1 WHEN 'u' THEN stay + v2 END) END AS c0,
      CASE WHEN goes THEN 2 + v1 ELSE least(2 + v1, 1 + stay + v2, CASE initial WHEN 'u' THEN stay + v2 END) END AS c1,
      CASE WHEN goes THEN 2 + v2 ELSE least(2 + v2, 1 + stay + v3, CASE initial WHEN 'a' THEN stay + v3 END) END AS c2,
      CASE WHEN goes THEN 2 + v3 ELSE least(2 + v3, 1 + stay + v2, CASE initial WHEN 'u' THEN stay + v2 END) END AS c3
    FROM back b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i WHERE b.i > 0)),
costs AS (SELECT conv_id, i, [v0, v1, v2, v3] AS v FROM back),
walk AS (
  SELECT conv_id, n, 0::BIGINT AS i, 0 AS q, '' AS audit, '' AS said, 0::BIGINT AS lines FROM sizes
  UNION ALL
  SELECT conv_id, n, i + (edit <> 'I')::BIGINT, CASE edit WHEN 'D' THEN q WHEN 'K' THEN kept ELSE put END, audit || edit,
    said || CASE WHEN edit = 'D' THEN '' ELSE CASE WHEN lines > 0 THEN chr(10) ELSE '' END
      || CASE WHEN edit = 'K' THEN role ELSE CASE put WHEN 2 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END END,
    lines + (edit <> 'D')::BIGINT
  FROM (
    SELECT w.*, role, text, kept, put, CASE
      WHEN w.i < n AND now[q + 1] = 2 + next[q + 1] THEN 'D'
      WHEN NOT coalesce(goes, false) AND now[q + 1] = 5 + now[put + 1] THEN 'I'
      WHEN kept IS NOT NULL AND now[q + 1] = stay + next[kept + 1] THEN 'K' ELSE 'R' END AS edit
    FROM (
      SELECT w.*, f.role, f.text, f.goes, f.stay, a.v AS now, b.v AS next, CASE WHEN q = 2 THEN 3 ELSE 2 END AS put,
        CASE WHEN f.initial = 's' AND q = 0 THEN 1 WHEN f.initial = 'u' AND q <> 2 THEN 2 WHEN f.initial = 'a' AND q = 2 THEN 3 END AS kept
      FROM walk w JOIN costs a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.i = w.i
      LEFT JOIN costs b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i + 1
      LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
      WHERE w.i < n OR q IN (1, 2)) w)),
ended AS (SELECT conv_id, audit, said FROM walk WHERE i = n AND q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(audit) DESC) = 1),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (is_blank)::BIGINT AS blank,
    count(*) FILTER (NOT is_blank AND nth > 1)::BIGINT AS duplicate, count(*) FILTER (truncated)::BIGINT AS truncated,
    count(*) FILTER (before IS NOT NULL AND left(before, 1) || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM faults GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v[1], 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN costs v ON v.conv_id IS NOT DISTINCT FROM o.conv_id AND v.i = 0
"""
