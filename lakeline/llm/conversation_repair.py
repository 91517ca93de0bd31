"""Repair of conversations at least cost, by rank-convergence parallel Viterbi.

A conversation's rows are to become `(s?(ua)+)?` in the initials of their roles. A row is kept (cost 0), reroled to user or
assistant (3) or deleted (4; blank and repeated rows must be), empty turns of user or assistant are inserted (3), and a
truncated row that isn't deleted adds 3. Four states say what stands before a row: nothing, s, u or a; a cost vector has
the least cost from each of them to the conversation's end.

The rows are sorted by range, so that a conversation with most of all rows spans many tasks, and cut into chunks. Each
chunk computes the costs at its begin from those at its end, which only a conversation's last chunk knows: the others start
from a speculative vector. Then fix-up passes follow: a chunk whose right neighbour gave a vector that differs from the one
it started from by more than a constant runs again. Vectors lose their dependence on the end within a few rows, unless all
rows must be deleted; what has not settled after `PASSES` passes gets its vectors from the chunks' cost matrices, put together in a
stream of one small row a chunk. The constants add up to the cost. Tracing goes forward along the backward costs and takes the
ASCII-least edit of least cost at each step, so the audit is the least of all cheapest ones; each chunk does so for all four
states before it, small rows in order say which one it is, and only then are its rows traced.

Defined cases: null ids make up one conversation; null roles and texts count as one space; null turns come first; rows of one
turn are ordered by role and by the MD5 of their text, equal rows stand together and all but the first are repeats; texts may
be of any length (the SHA-256 of a conversation of several chunks streams through one task, chunk by chunk, as it must);
an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from lakeline.llm.common import written

#: Rows in a chunk, and fix-up passes before the rest is stitched from matrices.
CHUNK_ROWS, PASSES = 128, 8
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing, s, u or a stands before. What is put after them by a rerole or an insertion, and the costs at the end.
NEXT, END = (2, 2, 3, 2), (0, 6, 3, 0)
NAMES = {2: "user", 3: "assistant"}
#: States after a kept row whose initial is s, u, a or another.
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
SPACE = " \t\n\x0b\x0c\r"


def options(code: int, state: int, after: tuple, before: tuple | None) -> Iterator[tuple[str, int, int, bool]]:
    """Edits at a row in ASCII order: (initial, cost to the end, next state, whether the row is consumed). Insertions need the row's own costs."""
    yield "D", DELETE + after[state], state, True
    if before is not None:
        yield "I", INSERT + before[NEXT[state]], NEXT[state], False
    if code:
        kind, extra = (code - 1) >> 1, TRUNCATED * ((code - 1) & 1)
        if state in KEPT[kind]:
            yield "K", extra + after[KEPT[kind][state]], KEPT[kind][state], True
        yield "R", REROLE + extra + after[NEXT[state]], NEXT[state], True


@functools.lru_cache(1 << 16)
def costs_before(code: int, after: tuple) -> tuple:
    """The costs before a row from those after it. code: 0 for a row that must go, else 1 + 2 * initial (s, u, a, other) + truncated."""
    least = [min(o[1] for o in options(code, s, after, None)) for s in range(4)]
    least[2] = min(least[2], INSERT + least[3])
    least[3] = min(least[3], INSERT + least[2])
    return tuple(min(c, INSERT + least[NEXT[s]]) for s, c in enumerate(least))


def normal(costs: tuple) -> tuple[tuple, int]:
    """Costs less their minimum, and that."""
    low = min(costs)
    return tuple(c - low for c in costs), low


def vectors(codes: bytes, right: tuple) -> tuple[list[tuple], int]:
    """Normal cost vectors before each row and after the last, and the sum of what was taken off."""
    found, total = [right], 0
    for code in reversed(codes):
        vector, low = normal(costs_before(code, found[-1]))
        found.append(vector)
        total += low
    return found[::-1], total


@functools.lru_cache(1 << 16)
def step(code: int, state: int, after: tuple) -> tuple[str, int]:
    """The least edits that consume a row, and the state that follows."""
    before, edits = costs_before(code, after), ""
    while True:
        edit, _, state, consumed = next(o for o in options(code, state, after, before) if o[1] == before[state])
        edits += edit
        if consumed:
            return edits, state


def traced(codes: bytes, found: list[tuple], state: int) -> tuple[list[str], int]:
    """Each row's edits and the state after the last row."""
    edits = []
    for code, after in zip(codes, found[1:]):
        edit, state = step(code, state, after)
        edits.append(edit)
    return edits, state


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, copies) after deterministic damage: copies is 0 for a dropped row and 2 for a repeated one."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word(conv_id), F.lit(":"), word(turn))) % 20
    new_text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word(text), "[.!?]", "")).otherwise(word(text))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(word(role)).alias("role"), new_text.alias("text"), copies.alias("copies"))


def coded(rows: DataFrame) -> DataFrame:
    """Every row with its place's columns, its fault, initial and code; equal rows are counted before they are shuffled."""
    counted = rows.where("copies > 0").groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("n")).withColumn("digest", F.md5("text"))
    first = counted.groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    named = first.select(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), F.col("first.turn").alias("first_turn"))
    seen = counted.join(named, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")))
    each = seen.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    trimmed = F.rtrim("text", F.lit(SPACE))
    repeated = (F.col("copy") > 1) | ~F.col("turn").eqNullSafe(F.col("first_turn"))
    fault = F.when(trimmed == "", "b").when(repeated, "d").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "t").otherwise("")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = F.when(F.col("fault").isin("b", "d"), 0).otherwise(1 + 2 * kind + (F.col("fault") == "t").cast("int"))
    return each.withColumn("fault", fault).select("conv", "turn", "role", "digest", "copy", "text", "fault", initial.alias("initial"), code.cast("int").alias("code"))


def chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows (part, at, alone, conv, codes, roles, texts, initials of its ends, counts): the conversations' chunks, in order of part and at.

    alone: the conversation begins and ends in this chunk for sure.
    """
    ordered = coded(rows).repartitionByRange("conv", "turn", "role", "digest", "copy").sortWithinPartitions("conv", "turn", "role", "digest", "copy").select("conv", "role", "text", "fault", "initial", "code")
    conv = ordered.schema["conv"].dataType
    schema = StructType([StructField("part", IntegerType()), StructField("at", LongType()), StructField("alone", BooleanType()), StructField("conv", conv), StructField("codes", BinaryType()), *StructType.fromDDL("roles array<string>, texts array<string>, first string, last string, blank long, duplicate long, truncated long, illegal long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            begins = np.append(np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)), n)
            cuts = np.concatenate([np.arange(a, b, chunk_rows) for a, b in zip(begins, begins[1:])])
            # a conversation is surely whole between the first and the last one of a batch
            whole = np.isin(cuts, begins[1:-2]) & (np.diff(np.append(cuts, n)) == np.diff(begins)[np.minimum(np.searchsorted(begins, cuts), len(begins) - 2)])
            offsets = pa.array(np.append(cuts, n), pa.int32())
            fault, initial, code = (batch.column(k).to_pylist() for k in (3, 4, 5))
            bad = np.array([i > 0 and (initial[i - 1] + initial[i]) not in ("su", "ua", "au") for i in range(n)])
            bad[cuts] = False
            counts = [np.add.reduceat(x.astype(np.int64), cuts) for x in ([np.array([f == k for f in fault]) for k in "bdt"] + [bad])]
            ends = np.append(cuts[1:], n)
            lists = [pa.ListArray.from_arrays(offsets, batch.column(k).cast(pa.string())) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cuts), part), pa.int32()), pa.array(np.arange(done, done + len(cuts))), pa.array(whole), batch.column(0).take(pa.array(cuts)), pa.array([bytes(code[a:b]) for a, b in zip(cuts, ends)], pa.binary()), *lists]
                + [pa.array([initial[a] for a in cuts], pa.string()), pa.array([initial[b - 1] for b in ends], pa.string()), *map(pa.array, counts)],
                names=schema.names,
            )
            done += len(cuts)

    return written(ordered.mapInArrow(run, schema), "chunks")


def numbered(found: DataFrame) -> DataFrame:
    """The chunks of conversations that may have several, in order: (part, at, conv, no, last, codes, illegal where it meets the chunk before)."""
    order = Window.partitionBy("conv").orderBy("part", "at")
    met = F.lag("last").over(order)
    broken = met.isNotNull() & ~F.concat(met, F.col("first")).isin("su", "ua", "au")
    some = found.where(~F.col("alone")).select("part", "at", "conv", "codes", "first", "last")
    return some.select("part", "at", "conv", "codes", F.row_number().over(order).alias("no"), F.lead("at").over(order).isNull().alias("ends"), broken.cast("long").alias("met"))


def solved(pieces: DataFrame, passes: int = PASSES) -> DataFrame:
    """pieces with `right`, the normal cost vector after each, and `left`, the one before it."""
    spec = "right array<int>, left array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, where = batch.schema.get_field_index("codes"), batch.schema.get_field_index("right")
            left = [vectors(c, tuple(r))[0][0] for c, r in zip(batch.column(at).to_pylist(), batch.column(where).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, pa.list_(pa.int32()))], names=[*batch.schema.names, "left"])

    def pass_over(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL("left array<int>").fields]))

    vector = lambda v: F.array(*[F.lit(x).cast("int") for x in v])
    rows = written(pass_over(pieces.withColumn("right", F.when(F.col("ends"), vector(END)).otherwise(vector((0, 0, 0, 0))))), "vectors")
    for _ in range(passes):
        wanted = F.lead("left").over(Window.partitionBy("conv").orderBy("no"))
        rows = rows.withColumn("wanted", F.coalesce(wanted, "right"))
        stale = written(rows, "neighbours")
        if not stale.where("wanted <> right").take(1):
            return stale.drop("wanted")
        kept = stale.where("wanted = right").drop("wanted")
        again = stale.where("wanted <> right").drop("right", "left").withColumnRenamed("wanted", "right")
        rows = written(kept.unionByName(pass_over(again)), "vectors")
    return stitched(rows.drop("right", "left"), spec)


def stitched(pieces: DataFrame, spec: str) -> DataFrame:
    """solved by cost matrices: each chunk's are computed side by side, then small rows are put together from a conversation's end."""
    far = 1 << 20

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for codes in batch.column(batch.schema.get_field_index("codes")).to_pylist():
                ends = [vectors(codes, tuple(0 if s == t else far for s in range(4))) for t in range(4)]
                found.append([c + total for v, total in ends for c in v[0]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "matrix"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = END
        for batch in batches:
            rights, lefts = [], []
            for ends, matrix in zip(batch.column(batch.schema.get_field_index("ends")).to_pylist(), batch.column(batch.schema.get_field_index("matrix")).to_pylist()):
                right = END if ends else right
                rights.append(right)
                right = normal(tuple(min(right[t] + matrix[4 * t + s] for t in range(4)) for s in range(4)))[0]
                lefts.append(right)
            keep = [i for i, name in enumerate(batch.schema.names) if name != "matrix"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *[pa.array(x, pa.list_(pa.int32())) for x in (rights, lefts)]], names=[*[batch.schema.names[i] for i in keep], "right", "left"])

    rows = pieces.mapInArrow(matrices, StructType([*pieces.schema.fields, *StructType.fromDDL("matrix array<long>").fields]))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.desc("no"))
    return ordered.mapInArrow(stream, StructType([*pieces.schema.fields, *StructType.fromDDL(spec).fields]))


def entered(pieces: DataFrame) -> DataFrame:
    """solved pieces with `entry`, the state before each: every piece says where each state leads to, small rows in order choose."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for codes, right in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("codes", "right"))):
                costs = vectors(codes, tuple(right))[0]
                found.append([traced(codes, costs, s)[1] for s in range(4)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "leads"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = 0
        for batch in batches:
            entries = []
            for no, leads in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("no", "leads"))):
                state = 0 if no == 1 else state
                entries.append(state)
                state = leads[state]
            keep = [i for i, name in enumerate(batch.schema.names) if name != "leads"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(entries, pa.int32())], names=[*[batch.schema.names[i] for i in keep], "entry"])

    rows = pieces.drop("left").mapInArrow(maps, StructType([*pieces.drop("left").schema.fields, *StructType.fromDDL("leads array<int>").fields]))
    ordered = rows.drop("codes").repartition("conv").sortWithinPartitions("conv", "no")
    return ordered.mapInArrow(stream, StructType([*rows.drop("codes", "leads").schema.fields, *StructType.fromDDL("entry int").fields]))


def repaired(found: DataFrame, passes: int = PASSES) -> DataFrame:
    """The chunks with their cheapest edits: (conv, no, alone, counts, cost, audit, roles, texts); cost is a chunk's share.

    The conversation's rows are those of its chunks in order of no.
    """
    states = written(entered(solved(numbered(found), passes)), "states").drop("conv")
    some = found.where(~F.col("alone")).join(states, ["part", "at"])
    end = F.array(*[F.lit(x).cast("int") for x in END])
    whole = found.where("alone").withColumns({"no": F.lit(1), "ends": F.lit(True), "met": F.lit(0).cast("long"), "right": end, "entry": F.lit(0)})
    rows = whole.unionByName(some).withColumn("illegal", F.col("illegal") + F.col("met")).select("conv", "no", "alone", "blank", "duplicate", "truncated", "illegal", "ends", "right", "entry", "codes", "roles", "texts")
    kept = ["conv", "no", "alone", "blank", "duplicate", "truncated", "illegal"]
    schema = StructType([*[rows.schema[c] for c in kept], *StructType.fromDDL("cost long, audit string, roles array<string>, texts array<string>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            costs, audits, all_roles, all_texts = [], [], [], []
            for no, ends, right, state, codes, roles, texts in zip(*(col(c).to_pylist() for c in ("no", "ends", "right", "entry", "codes", "roles", "texts"))):
                by_row, total = vectors(codes, tuple(right))
                # the costs before a conversation's first row count from the first state
                costs.append(total + (by_row[0][0] if no == 1 else 0))
                edits, _ = traced(codes, by_row, state)
                out_roles, out_texts = [], []
                for edit, code, role, text in zip(edits, codes, roles, texts):
                    for e in edit:
                        if e == "K":
                            state = KEPT[(code - 1) >> 1][state]
                            out_roles.append(role)
                        elif e != "D":
                            state = NEXT[state]
                            out_roles.append(NAMES[state])
                        if e != "D":
                            out_texts.append("" if e == "I" else text)
                while ends and END[state]:
                    state = NEXT[state]
                    edits.append("I")
                    out_roles.append(NAMES[state])
                    out_texts.append("")
                audits.append("".join(edits))
                all_roles.append(out_roles)
                all_texts.append(out_texts)
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*map(col, kept), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(all_roles, strings), pa.array(all_texts, strings)], names=schema.names)

    return rows.mapInArrow(run, schema)


COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def digests(pieces: DataFrame) -> DataFrame:
    """Rows (conv, counts, cost, audit, repaired_sha256), one per conversation that has rows."""
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    whole = pieces.where("alone").select("conv", *COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    some = pieces.where(~F.col("alone")).select("conv", "no", *COUNTS, "audit", F.when(F.size("roles") > 0, lines).alias("body"))
    counted = some.groupBy("conv").agg(*[F.sum(c).alias(c) for c in COUNTS], F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    hashed = StructType([some.schema["conv"], StructField("repaired_sha256", StringType())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha, filled = None, None, False
        for batch in batches:
            ids, out = [], []
            for conv, no, body in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                if no == 1:
                    if sha:
                        ids.append(own)
                        out.append(sha.hexdigest())
                    own, sha, filled = conv, hashlib.sha256(), False
                if body.is_valid:
                    sha.update(b"\n" * filled + body.as_buffer().to_pybytes())
                    filled = True
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in ids], batch.schema.field(0).type), pa.array(out, pa.string())], names=hashed.names)
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([own.as_py()], own.type), pa.array([sha.hexdigest()], pa.string())], names=hashed.names)

    shas = some.select("conv", "no", "body").repartition("conv").sortWithinPartitions("conv", "no").mapInArrow(stream, hashed)
    named = shas.select(F.col("conv").alias("_c"), "repaired_sha256")
    return whole.unionByName(counted.join(named, F.col("conv").eqNullSafe(F.col("_c"))).drop("_c"))


def report(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, passes: int = PASSES) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one for every conversation of rows (as damaged gives them)."""
    there: Column = F.when(F.col("copies") > 0, F.col("turn"))
    gaps = rows.groupBy(F.col("conv").alias("conv_id")).agg((F.max(there) - F.min(there) + 1 - F.count_distinct(there)).alias("gaps"))
    found = digests(repaired(chunks(rows, chunk_rows), passes))
    joined = gaps.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS)]
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: The same rows in SQL: damage, faults, then forward over the rows with the least (cost, audit) for each state.
ORACLE = r"""
with recursive
named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
hashed as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(name, ''), lambda c: ord(c)::bigint)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 20 as kind from named),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, kind,
  unnest(case when kind = 0 then [] when kind = 3 then [1, 2] else [1] end) as copy from hashed),
ranked as (select *, rtrim(text, e' \t\n\x0b\x0c\r') as trimmed, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as i from damaged),
faults as (select *, role[1] as initial, lag(role[1]) over (partition by conv_id order by i) as previous, case when trimmed = '' then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd' when trimmed[-1] not in ('.', '!', '?') then 't' else '' end as fault from ranked),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
  count(*) filter (previous is not null and previous || initial not in ('su', 'ua', 'au')) as illegal, max(i) as n from faults group by conv_id),
path as (
  select conv_id, 0::bigint as i, s.st, s.cost, s.audit, s.body from (select distinct conv_id from conversations),
    (select unnest([{'st': 0, 'cost': 0, 'audit': '', 'body': []::varchar[]}, {'st': 2, 'cost': 3, 'audit': 'I', 'body': ['user:']}, {'st': 3, 'cost': 6, 'audit': 'II', 'body': ['user:', 'assistant:']}]) as s)
  union all
  select conv_id, i, st, best.cost, best.audit, best.body from (
    select p.conv_id, f.i, n.st, min({'cost': p.cost + o.cost + 3 * len(n.edits), 'audit': p.audit || o.edit || n.edits, 'body': list_concat(p.body, o.line, n.line)}) as best
    from path p join faults f on f.conv_id is not distinct from p.conv_id and f.i = p.i + 1,
    lateral (select unnest([{'edit': 'D', 'st': p.st, 'cost': 4, 'line': []::varchar[]},
      {'edit': 'K', 'st': case when f.initial = 's' and p.st = 0 then 1 when f.initial = 'u' and p.st <> 2 then 2 when f.initial = 'a' and p.st = 2 then 3 else -1 end, 'cost': case f.fault when 't' then 3 else 0 end, 'line': [f.role || ':' || f.text]},
      {'edit': 'R', 'st': case when p.st = 2 then 3 else 2 end, 'cost': case f.fault when 't' then 6 else 3 end, 'line': [case when p.st = 2 then 'assistant:' else 'user:' end || f.text]}]) as o),
    lateral (select unnest([{'st': o.st, 'edits': '', 'line': []::varchar[]},
      {'st': case when o.st = 2 then 3 else 2 end, 'edits': 'I', 'line': [case when o.st = 2 then 'assistant:' else 'user:' end]},
      {'st': case when o.st = 2 then 2 else 3 end, 'edits': 'II', 'line': case when o.st = 2 then ['assistant:', 'user:'] else ['user:', 'assistant:'] end}]) as n)
    where o.st >= 0 and (o.edit = 'D' or f.fault not in ('b', 'd')) group by p.conv_id, f.i, n.st)
),
best as (select c.conv_id, min({'cost': p.cost, 'audit': p.audit, 'body': p.body}) as b from (select distinct conv_id from conversations) c left join counts n on n.conv_id is not distinct from c.conv_id
  join path p on p.conv_id is not distinct from c.conv_id and p.i = coalesce(n.n, 0) where p.st in (0, 3) group by c.conv_id)
select b.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  b.b.cost::bigint as cost, b.b.audit as audit, sha256(array_to_string(b.b.body, e'\n')) as repaired_sha256
from best b left join counts n on n.conv_id is not distinct from b.conv_id
"""
