"""Chat formatting after collapse of cumulative snapshots.

Chat logs often hold a conversation again after every turn, so most logged conversations are a prefix of a longer
one. Every turn has a digest, and a rolling hash over the digests names each prefix of a conversation: the hash after
a turn is the hash before it times a base, plus the turn's digest, modulo a Mersenne prime of 127 bits. The hash at a
conversation's last turn names it whole. Equal conversations are one, the smallest conv_id of them; an anti-join
against the hashes and lengths of all proper prefixes leaves the maximal conversations; only these are rendered.

Rolling hashes of two stretches combine, so turns are dealt over range partitions in the order of conversation and
turn: a conversation may be longer than any task. What goes to the driver is a row for each partition. A rendered
conversation comes in pieces of at most ``TURNS`` turns, for the same reason.

Defined results: null roles and texts are empty; turns stand in the order of turn (null first), those of equal turn
in the order of their digest; repeated rows of a conversation are one turn; rows without conv_id are one conversation,
which loses to an equal one with an id; marks of the format inside roles and texts are broken by a blank; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import cut, shuffle_parts

#: Turns of a rendered piece.
TURNS = 64
PRIME, BASE = (1 << 127) - 1, 0x3C6EF372FE94F82BA54FF53A5F1D36F1
# The marks of the format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PLACED = "conv_id long, turn long, digest binary, place long, prefix binary, last boolean"


def rolled(state: int, digest: bytes) -> int:
    return (state * BASE + int.from_bytes(digest[:16], "big") + 1) % PRIME


def stretches(batches):
    """A row for each partition: its first and last conversation, how many of its turns they have and their hashes."""
    first, now, count, state, parts = None, None, 0, 0, 0
    part = 0
    for batch in batches:
        for conv, digest, part in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):  # noqa: B020
            if not parts or conv != now:
                if parts == 1:
                    first = (now, count, state)
                parts, now, count, state = parts + 1, conv, 0, 0
            count, state = count + 1, rolled(state, digest)
    if parts:
        first = first or (now, count, state)
        row = [part, first[0], first[1], first[2].to_bytes(16, "big"), parts == 1, now, count, state.to_bytes(16, "big")]
        yield pa.RecordBatch.from_pylist([dict(zip(EDGES.names, row, strict=True))], schema=EDGES)


EDGES = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("first_n", pa.int64()), ("first_hash", pa.binary()), ("whole", pa.bool_()), ("final", pa.int64()), ("final_n", pa.int64()), ("final_hash", pa.binary())])


def carried(edges: list) -> dict[int, tuple[int, int, bool]]:
    """For each partition the turns and the hash that its first conversation has before it, and whether its last goes on behind it."""
    out, conv, n, state = {}, object(), 0, 0
    for k, e in enumerate(sorted(edges, key=lambda e: e["part"])):
        goes_on = e["first"] == conv
        n, state = (n, state) if goes_on else (0, 0)
        out[e["part"]] = [n, state, False]
        if k and goes_on:
            out[before][2] = True  # noqa: F821
        if e["whole"]:
            n, state = n + e["first_n"], (state * pow(BASE, e["first_n"], PRIME) + int.from_bytes(e["first_hash"], "big")) % PRIME
        else:
            n, state = e["final_n"], int.from_bytes(e["final_hash"], "big")
        conv, before = e["final"], e["part"]
    return {k: tuple(v) for k, v in out.items()}


def prefixed(carry: dict[int, tuple[int, int, bool]]):
    """Adds to each turn its place in the conversation, the hash of the prefix that ends with it, and whether it is the last."""

    def run(batches):
        held, now, n, state, on = None, None, 0, 0, False
        for batch in batches:
            out = []
            for conv, turn, digest, part in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held is None:
                    n, state, on = carry[part]
                elif conv != now:
                    n, state = 0, 0
                if held is not None:
                    out.append((*held, conv != now))
                now, n, state = conv, n + 1, rolled(state, digest)
                held = (conv, turn, digest, n, state.to_bytes(16, "big"))
            yield filled(out)
        if held is not None:
            yield filled([(*held, not on)])

    return run


def filled(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_()]
    cols = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in PLACED.split(", ")])


def told(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, role, text of every row."""
    filled_in = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled_in("role").alias("role"), filled_in("text").alias("text"))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.select("conv_id", "turn", F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), "role", "text")


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, place, prefix and last of every distinct turn."""
    spark = conversations.sparkSession
    keys = ["conv_id", "turn", "digest"]
    rows = cut(told(conversations).select(*keys).distinct())
    dealt = cut(rows.repartitionByRange(shuffle_parts(spark), *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
    types = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}
    edges = dealt.mapInArrow(stretches, ", ".join(f"{f.name} {types[f.type]}" for f in EDGES)).collect()  # a row for each partition
    return cut(dealt.mapInArrow(prefixed(carried(edges)), PLACED))


def maximal(placed: DataFrame) -> DataFrame:
    """conv_id, turns and copies (equal conversations) of those that are no proper prefix of another."""
    ends = placed.where("last").groupBy("place", "prefix").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = placed.where("not last").select("place", "prefix").distinct()
    return ends.join(inner, ["place", "prefix"], "left_anti").select("conv_id", F.col("place").alias("turns"), "copies")


def rendered(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """The maximal conversations in pieces: conv_id, piece, first_turn, n_turns, copies, rendered."""
    placed = turn_prefixes(conversations)
    kept = maximal(placed).select(F.col("conv_id").alias("kept_id"), "copies")
    stand = placed.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("digest").alias("d"), "place", "copies")
    rows = told(conversations)
    full = rows.join(stand, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("digest") == F.col("d")))
    safe = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    one = F.concat(F.lit(OPEN), safe("role"), F.lit("\n"), safe("text"), F.lit(CLOSE + "\n"))
    # A set: rows that repeat a turn fall together before the shuffle, so a group holds at most ``turns``.
    piece = F.floor((F.col("place") - 1) / turns)
    groups = full.select("conv_id", "copies", piece.cast("int").alias("piece"), F.struct("place", one.alias("said")).alias("x")).groupBy("conv_id", "copies", "piece").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    return groups.select("conv_id", "piece", (F.col("piece") * F.lit(turns)).cast("long").alias("first_turn"), F.size("xs").cast("long").alias("n_turns"), "copies", F.array_join(F.transform("xs", lambda x: x["said"]), "").alias("rendered"))
