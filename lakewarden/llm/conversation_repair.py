"""Conversation structure repair: a generalised LR parse of the roles with weighted edits.

Conversations should read `(s? (ua)+)?` in role initials: an optional system turn, then user and assistant in turn, or
nothing. The grammar is C -> nothing | B | s B; B -> u a | B u a. A row may be kept, given another role or deleted, and empty
rows may be inserted, each at a price. All readings go on side by side in a graph-structured stack: a node is an LR state and
the node below it; readings whose stacks have equal tops meet in one node, of which the one of minimum (cost, audit) stays
(audit: the initials of the edits). That loses nothing: what may follow depends on the top alone, and among readings of equal
cost at one place no audit is the beginning of another, as that would take further inserts.

Spark deals the rows by conversation and chunk. A conversation of at most `chunk` rows is parsed as one; a longer one is
numbered by range partitions and two-level sums, each chunk of it is parsed from all eight stacks that the grammar can have
there, and the chunks' cheapest readings are joined in order. Only those readings, not rows, of a long conversation meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, partitions, range_dealt, running, stored, table

#: Prices of the edits; UNFINISHED is added for a truncated row that stays.
RENAME, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = ("su", "ua", "au")
CHUNK = 1024  # rows that are parsed as one

#: The LR automaton. 0: start, 1: after s, 2: after the u of a first pair, 3: that pair, 4: after B, 5: after a further u,
#: 6: a further pair, 7: after s B. A handle is reduced as soon as it is whole.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (4, "u"): 5, (7, "u"): 5, (5, "a"): 6}
HANDLE = {3: 2, 6: 3}  # nodes to pop before B goes on
GOTO = {0: 4, 1: 7}
ACCEPTED = (0, 4, 7)
#: All stacks that can stand between two rows.
STACKS = [(0,), (0, 1), (0, 2), (0, 1, 2), (0, 4), (0, 1, 7), (0, 4, 5), (0, 1, 7, 5)]


def shift(node: tuple, symbol: str) -> tuple | None:
    """The node after the symbol, with its handle reduced; None where the grammar has no place for it."""
    to = SHIFT.get((node[0], symbol))
    if to is None:
        return None
    node = (to, node)
    if to in HANDLE:
        for _ in range(HANDLE[to]):
            node = node[1]
        node = (GOTO[node[0]], node)
    return node


def meet(tops: dict, cost: int, audit: str, node: tuple | None) -> bool:
    """Put a reading among the tops; of those with one top the minimum stays."""
    if node is None or (node[0] in tops and tops[node[0]][:2] <= (cost, audit)):
        return False
    tops[node[0]] = (cost, audit, node)
    return True


def insertions(tops: dict) -> dict:
    """The tops with all that inserted rows can reach."""
    waiting = list(tops)
    while waiting:
        cost, audit, node = tops[waiting.pop()]
        for symbol in ROLES:
            after = shift(node, symbol)
            if meet(tops, cost + INSERT, audit + "I", after):
                waiting.append(after[0])
    return tops


def readings(rows: list[tuple[str, str]], stack: tuple) -> dict[int, tuple[int, int, str]]:
    """From a stack over rows (role initial, fault): stack at the end -> (cost, audit), the cheapest for each top."""
    node = None
    for state in stack:
        node = (state, node)
    tops = insertions({node[0]: (0, "", node)})
    for initial, fault in rows:
        after: dict = {}
        for cost, audit, node in tops.values():
            meet(after, cost + DELETE, audit + "D", node)
            if fault in ("", "truncated"):
                stays = cost + (UNFINISHED if fault else 0)
                meet(after, stays, audit + "K", shift(node, initial))
                for symbol in ROLES:
                    meet(after, stays + RENAME, audit + "R", shift(node, symbol))
        tops = insertions(after)
    return {_stack(node): (cost, audit) for cost, audit, node in tops.values()}


def _stack(node: tuple) -> int:
    states = []
    while node:
        states.append(node[0])
        node = node[1]
    return STACKS.index(tuple(reversed(states)))


def faults(rows: list[tuple[str, str, bool]]) -> list[str]:
    """The first fault of each row (role, text, seen in an earlier chunk): blank, duplicate, truncated or none."""
    out, met = [], set()
    for role, text, seen in rows:
        end = text.rstrip(WHITE)[-1:]
        out.append("blank" if not end else "duplicate" if seen or (role, text) in met else "truncated" if end not in ENDS else "")
        met.add((role, text))
    return out


def lines(rows: list[tuple[str, str]], audit: str, stack: tuple) -> list[str]:
    """The repaired `role:text` lines of rows (role, text) under the edits of an audit, from a stack."""
    out, at, after = [], 0, stack[-1]
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        symbol = role[:1] if edit == "K" else "a" if after in (2, 5) else "u"
        out.append(f"{role if edit == 'K' else ROLES[symbol]}:{text}")
        after = {"s": 1, "u": 2, "a": 4}[symbol]
    return out


PARSED = "_k string, _chunk long, _whole boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, paths array<struct<entry:int,exit:int,cost:long,audit:string>>, repaired string, n_lines long, roles array<string>, texts array<string>"
PARSED_ARROW = pa.schema(
    [("_k", pa.string()), ("_chunk", pa.int64()), ("_whole", pa.bool_()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("first", pa.string()), ("last", pa.string())]
    + [("paths", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))), ("repaired", pa.string()), ("n_lines", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
)


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns], strict=True)


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    some: list[dict] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_pylist(some, schema)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk; rows come in order, one chunk is held at a time."""

    def chunks():
        for (key, chunk, whole), group in groupby(_rows(batches, "_k", "_chunk", "_whole", "_r", "_x", "_seen"), lambda r: r[:3]):
            rows = [r[3:] for r in group]
            found, initials = faults(rows), [r[0][:1] for r in rows]
            out = {"_k": key, "_chunk": chunk, "_whole": whole, "first": initials[0], "last": initials[-1]} | {f: found.count(f) for f in ("blank", "duplicate", "truncated")}
            out["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            steps, pairs = list(zip(initials, found, strict=True)), [r[:2] for r in rows]
            if whole:
                cost, audit = min(v for k, v in readings(steps, (0,)).items() if STACKS[k][-1] in ACCEPTED)
                said = lines(pairs, audit, (0,))
                yield out | {"paths": [{"entry": 0, "exit": 0, "cost": cost, "audit": audit}], "repaired": "\n".join(said), "n_lines": len(said)}
            else:
                paths = [{"entry": i, "exit": k, "cost": cost, "audit": audit} for i, stack in enumerate(STACKS) for k, (cost, audit) in readings(steps, stack).items()]
                yield out | {"paths": paths, "roles": [p[0] for p in pairs], "texts": [p[1] for p in pairs]}

    return _batched(chunks(), PARSED_ARROW)


CHOSEN_ARROW = pa.schema([("_k", pa.string()), ("_chunk", pa.int64()), ("entry", pa.int32()), ("chosen", pa.string())] + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the readings of a conversation's chunks in order. A row for each chunk with its entry and audit, then one (_chunk -1)
    with the conversation's sums, cost and audit. Held: the best audit of each stack and each chunk's way back."""

    def chosen():
        for key, group in groupby(_rows(batches, "_k", "_chunk", "blank", "duplicate", "truncated", "illegal", "first", "last", "paths"), lambda r: r[0]):
            best, back, sums, before = {0: (0, "")}, [], [0, 0, 0, 0], None
            for _, chunk, blank, duplicate, truncated, illegal, first, last, paths in group:
                crossing = before is not None and before + first not in LEGAL
                sums = [a + b for a, b in zip(sums, (blank, duplicate, truncated, illegal + crossing), strict=True)]
                before, after = last, {}
                for p in paths:
                    if p["entry"] in best:
                        cost, audit = best[p["entry"]]
                        way = (cost + p["cost"], audit + p["audit"], p["entry"], p["audit"])
                        top = STACKS[p["exit"]][-1]
                        if top not in after or way[:2] < after[top][1][:2]:
                            after[top] = (p["exit"], way)
                best = {k: way[:2] for k, way in after.values()}
                back.append((chunk, {k: way[2:] for k, way in after.values()}))
            (cost, audit), at = min((v, k) for k, v in best.items() if STACKS[k][-1] in ACCEPTED)
            yield {"_k": key, "_chunk": -1, "chosen": audit, "cost": cost} | dict(zip(("blank", "duplicate", "truncated", "illegal"), sums, strict=True))
            for chunk, ways in reversed(back):
                entry, own = ways[at]
                yield {"_k": key, "_chunk": chunk, "entry": entry, "chosen": own}
                at = entry

    return _batched(chosen(), CHOSEN_ARROW)


PART_ARROW = pa.schema([("_k", pa.string()), ("_chunk", pa.int64()), ("repaired", pa.string()), ("n_lines", pa.int64())])


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts():
        for key, chunk, entry, audit, roles, texts in _rows(batches, "_k", "_chunk", "entry", "chosen", "roles", "texts"):
            said = lines(list(zip(roles, texts, strict=True)), audit, STACKS[entry])
            yield {"_k": key, "_chunk": chunk, "repaired": "\n".join(said), "n_lines": len(said)}

    return _batched(parts(), PART_ARROW, 16)


def _in_chunks(rows: DataFrame, order: list[str], chunk: int) -> DataFrame:
    """rows with _chunk, _whole (the conversation is one chunk) and _seen (role and text stood in an earlier chunk)."""
    sizes = stored(rows.groupBy("_k").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > chunk).select("_k"), "repair-long")
    if sizes.isEmpty():
        return rows.select("*", F.lit(0).cast("long").alias("_chunk"), F.lit(True).alias("_whole"), F.lit(False).alias("_seen"))
    short = rows.join(sizes, "_k", "left_anti").select("*", F.lit(0).cast("long").alias("_chunk"), F.lit(True).alias("_whole"), F.lit(False).alias("_seen"))
    dealt = range_dealt(rows.join(sizes, "_k", "left_semi"), ["_k", *order], "repair-dealt")
    numbered = stored(running(dealt, order, F.lit(1), "_n", ["_k"]).withColumn("_chunk", F.floor((F.col("_n") - 1) / chunk).cast("long")).drop("_n", "_pid"), "repair-numbered")
    # an earlier chunk with this role and text: a hot text is a row for each of its chunks here
    met = numbered.select("_k", "_r", "_d", "_chunk").distinct()
    first = met.groupBy("_k", "_r", "_d").agg(F.min("_chunk").alias("_first"))
    later = met.join(first, ["_k", "_r", "_d"]).filter("_chunk > _first").select("_k", "_r", "_d", "_chunk", F.lit(True).alias("_seen"))
    long = numbered.join(later, ["_k", "_r", "_d", "_chunk"], "left").select(*rows.columns, "_chunk", F.lit(False).alias("_whole"), F.coalesce("_seen", F.lit(False)).alias("_seen"))
    return short.unionByName(long)


def repair_conversations(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(summary, parts) of the conversations in df.

    summary, a row a conversation: conv_id, gaps (turns missing between its first and last, null turns ignored), blank,
    duplicate, truncated (rows by their first fault), illegal (neighbours whose role initials are not su, ua or au), cost and
    audit of the cheapest repair (ties: least audit by ASCII). parts: conv_id, part, repaired (`role:text` lines joined by line
    feeds), n_lines, one row for each `chunk` rows; a conversation's text is its parts with lines, in order.

    Rows stand in the order of turn, nulls first, ties by role and MD5 of the text. Null role or text: one space. Roles count by
    their first letter; a role without a legal one can't be kept as it is. Null conversation ids are one conversation. Repeated
    rows are duplicates but the first; very long texts are only looked at from their end. An empty table gives empty results;
    other columns are ignored. A conversation may hold any share of the rows: only chunks of it are held at a time.
    """
    id_type = df.schema[conv_col].dataType
    key = F.coalesce(F.concat(F.lit("="), named(df, conv_col).cast("string")), F.lit(""))
    rows = df.select(key.alias("_k"), named(df, turn_col).alias("_t"), F.coalesce(named(df, role_col), F.lit(" ")).alias("_r"), F.coalesce(named(df, text_col), F.lit(" ")).alias("_x"))
    rows = rows.withColumn("_d", F.md5(F.col("_x").cast("binary")))
    order = ["_t", "_r", "_d"]
    n = partitions(df.sparkSession)
    dealt = _in_chunks(rows, order, chunk).repartition(n, "_k", "_chunk").sortWithinPartitions("_k", "_chunk", *order)
    parsed = stored(dealt.mapInArrow(_parse, PARSED), "repair-parsed")
    counts = ["blank", "duplicate", "truncated", "illegal"]
    own = F.col("paths")[0]
    whole = parsed.filter("_whole")
    summary = whole.select("_k", *counts, own["cost"].alias("cost"), own["audit"].alias("audit"))
    parts = whole.select("_k", "_chunk", "repaired", "n_lines")
    long = parsed.filter("not _whole")
    if not long.isEmpty():
        in_order = long.select("_k", "_chunk", *counts, "first", "last", "paths").repartition(n, "_k").sortWithinPartitions("_k", "_chunk")
        chosen = stored(in_order.mapInArrow(_choose, "_k string, _chunk long, entry int, chosen string, blank long, duplicate long, truncated long, illegal long, cost long"), "repair-chosen")
        summary = summary.unionByName(chosen.filter("_chunk < 0").select("_k", *counts, "cost", F.col("chosen").alias("audit")))
        told = long.select("_k", "_chunk", "roles", "texts").join(chosen.filter("_chunk >= 0").select("_k", "_chunk", "entry", "chosen"), ["_k", "_chunk"])
        parts = parts.unionByName(told.mapInArrow(_replay, "_k string, _chunk long, repaired string, n_lines long"))
    gaps = rows.groupBy("_k").agg(F.coalesce(F.max("_t") - F.min("_t") + 1 - F.count_distinct("_t"), F.lit(0)).cast("long").alias("gaps"))
    conv = F.when(F.col("_k") != "", F.substring("_k", 2, 1 << 30)).cast(id_type).alias("conv_id")
    return summary.join(gaps, "_k").select(conv, "gaps", *counts, "cost", "audit"), parts.select(conv, F.col("_chunk").alias("part"), "repaired", "n_lines")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's parts as they come; null parts have no lines."""

    def digests():
        for key, group in groupby(_rows(batches, "conv_id", "repaired"), lambda r: r[0]):
            seen, some = hashlib.sha256(), False
            for _, text in group:
                if text is not None:
                    seen.update((b"\n" if some else b"") + text.encode())
                    some = True
            yield {"conv_id": key, "repaired_sha256": seen.hexdigest()}

    return _batched(digests(), pa.schema([("conv_id", pa.string()), ("repaired_sha256", pa.string())]))


def repaired_digests(parts: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of all conversations in parts. One part is digested where it is; the parts of a
    longer one go in order through one task, which holds one of them at a time."""
    several = stored(parts.groupBy("conv_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("conv_id"), "repair-several")
    one = parts.select("conv_id", F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))
    if several.isEmpty():
        return one
    among = parts["conv_id"].eqNullSafe(several["conv_id"])
    one = parts.join(several, among, "left_anti").select("conv_id", F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))
    id_type = parts.schema["conv_id"].dataType
    lined = parts.join(several, among, "left_semi").select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv_id"), "part", "n_lines", "repaired")
    lined = lined.filter("n_lines > 0 or part = 0").withColumn("repaired", F.when(F.col("n_lines") > 0, F.col("repaired")))
    dealt = lined.repartition(partitions(parts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    more = dealt.mapInArrow(_digest, "conv_id string, repaired_sha256 string")
    return one.unionByName(more.select(F.when(F.col("conv_id") != "", F.substring("conv_id", 2, 1 << 30)).cast(id_type).alias("conv_id"), "repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the contract's damage, dealt out by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes its
    `.!?`, 3 repeats it, 4 sets its role to user. Nulls in role and text, and in what is digested: one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), (F.crc32(F.concat_ws(":", told("conv_id"), told("turn")).cast("binary")) % 20).alias("_h"))
    role = F.when(F.col("_h") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("_h") == 1, F.lit("")).when(F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("_h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter("_h <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged as the contract says and repaired."""
    conversations = table(spark, sf_dir, "conversations")
    summary, parts = repair_conversations(damaged(conversations))
    digests = repaired_digests(parts)
    every = conversations.select("conv_id").distinct()
    out = every.join(summary.withColumnRenamed("conv_id", "_s"), F.col("conv_id").eqNullSafe(F.col("_s")), "left").join(digests.withColumnRenamed("conv_id", "_d"), F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
