"""Set-similarity self-join of documents on word n-grams, by vertical partitioning.

A document's set holds its distinct word n-grams, hashed to 64 bits; documents of equal sets (by a 128-bit digest of all
hashes) are one class from the start. All n-grams stand in one global order: frequent ones last, by a count sketch of the whole corpus, and by hash
within. The order is cut into fragments twice.

Candidates: two sets that reach the threshold share an n-gram among the first few of each (their prefix). Each
fragment of the order gets the prefix n-grams that fall into it and names, for every n-gram of several documents, the
smallest of them as leader. A document meets those whose leader it shares; these are stars, so their number grows
with the documents however often an n-gram occurs.

Counting: members that meet are compared fragment by fragment: the overlaps of all pairs within a fragment of the
order are counted separately and summed for each pair, and pairs that what is still to come cannot lift to the
threshold no longer count. This is done twice. First with the prefixes of a leader's members alone: what lies behind
a prefix bounds the rest of the overlap, which rules out documents that share a passage and no more. Documents that
remain connected form a component, in which whole sets are compared, so a whole set travels once. A group larger
than a block becomes cells of two blocks of similar sizes; cells whose sizes rule out every pair are left out. A cell
gives a forest that connects what it linked, never its pairs, and components follow from the forests.

Two sets link when their intersection is at least ``num / den`` of their union, in whole numbers. Sets are
compared by 60 bits of each hash, beside the class of its frequency: two different n-grams of one pair are taken as one
with a chance of about 1e-11 for two sets of 4,000.

Defined results: null and blank texts have an empty set and link with nothing; a text of fewer words than an n-gram
is one n-gram; equal doc_ids are one document for links; a null doc_id never leads and takes the component of its
set; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import by_class, connected_components, cut, numbered, ranked, shuffle_parts

#: Parts in which the corpus sketch and the sieve travel, and least and most bits of their size. Both grow with the corpus
#: up to the most, which bounds what is broadcast; they only save work, so results are alike beyond it.
SKETCH_PARTS, SKETCH_BITS, SIEVE_BITS = 64, (16, 24), (16, 26)
#: Members of a block; a cell holds two.
BLOCK = 512
#: Keys of a stretch of the global order and columns of a fragment while a cell is counted.
STRETCH, FRAGMENT = 1 << 18, 1024
#: Rows and characters of text shingled at once, and postings a task holds before it hands them on.
ROWS, CHUNK, HELD = 256, 1 << 19, 1 << 18
SEED, LONG = 0x9E3779B97F4A7C15, 1024


def finished(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, and how many each text has.

    A word is read in blocks of eight bytes, each mixed into what the blocks before it gave; there is no sum over
    bytes in which different words could cancel out. Words above LONG bytes are hashed by BLAKE2."""
    parts = [t.encode("utf-8", "replace").lower() for t in texts]
    raw = b" " + b" ".join(parts) + b" " * 9
    data = np.frombuffer(raw, np.uint8)[:-8]
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    size = ends - begins
    blocks = np.ndarray((len(data),), np.dtype("<u8"), raw, strides=(1,))
    hashes = finished(size.astype(np.uint64) * np.uint64(SEED) + np.uint64(1))
    long = size > LONG
    at = np.flatnonzero(~long)
    done = 0
    while len(at):
        rest = np.minimum(size[at] - done, 8).astype(np.uint64)
        block = blocks[begins[at] + done] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * rest))
        hashes[at] = finished((hashes[at] ^ block) * np.uint64(SEED) + block)
        done += 8
        at = at[size[at] > done]
    for k in np.flatnonzero(long).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(raw[begins[k] : ends[k]], digest_size=8).digest(), "little")
    texts_end = np.cumsum([len(p) + 1 for p in parts])
    counts = np.diff(np.r_[0, np.searchsorted(begins, texts_end, "right")])
    return hashes, counts


def chained(words: list[np.ndarray]) -> np.ndarray:
    """A hash of each sequence of words, given as its first, second, ... words."""
    out = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        out = finished((out ^ w) * np.uint64(SEED) + w)
    return out


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """For each text its distinct n-gram hashes, sorted."""
    hashes, counts = word_hashes(texts)
    n_grams = max(0, len(hashes) - width + 1)
    grams = chained([hashes[k : k + n_grams] for k in range(width)])
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(grams[at : at + n - width + 1]))
        elif n:
            out.append(chained(list(hashes[at : at + n, None])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def in_chunks(batches, width: int):
    """(doc_id, set) of every row."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            few = batch.slice(begin, ROWS)
            ids, texts = few.column(0).to_pylist(), [t or "" for t in few.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                stop, size = at + 1, len(texts[at])
                while stop < len(texts) and size + len(texts[stop]) < CHUNK:
                    size += len(texts[stop])
                    stop += 1
                yield from zip(ids[at:stop], shingle_sets(texts[at:stop], width), strict=True)
                at = stop


SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
PREFIXES = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("grams", pa.binary())])
POSTINGS = pa.schema([("fragment", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary())])
STARS = pa.schema([("leader", pa.int64()), ("member", pa.int64())])
MEMBERS = pa.schema([("rep", pa.int64()), ("size", pa.int64()), ("grams", pa.binary())])
FOREST = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def bits_for(count: int, more: int, bounds: tuple[int, int]) -> int:
    """The bits of a number ``more`` powers of two above ``count``, within bounds."""
    return max(bounds[0], min(bounds[1], count.bit_length() + more))


def counter(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def summarised(width: int, bits: int):
    """A row for each document with the key of its set, and the task's share of the corpus sketch: each set once."""

    def run(batches):
        sketch, seen, rows = np.zeros(1 << bits, np.uint32), set(), []
        for doc, grams in in_chunks(batches, width):
            key = set_key(grams)
            rows.append((doc, len(grams), key, None, None))
            if key not in seen:
                seen.add(key)
                np.add.at(sketch, counter(grams, bits), np.uint32(1))
            if len(rows) >= 4096:
                yield batch_of(rows, SETS)
                rows = []
        yield batch_of(rows, SETS)
        if seen:
            for k, part in enumerate(np.split(sketch, SKETCH_PARTS)):
                yield batch_of([(None, None, None, k, zlib.compress(part.tobytes(), 1))], SETS)

    return run


def summed(batches):
    """The sketch's parts of all tasks added up, one part at a time in memory for each of SKETCH_PARTS."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
            total[k] = total[k] + counts if k in total else counts
    for k, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(np.minimum(counts, 2**32 - 1).astype(np.uint32).tobytes(), 1)], pa.binary())], names=["part", "counts"])


def rarity(sketch: np.ndarray) -> np.ndarray:
    """For each counter a class from 0 (no more than chance puts there) to 15: powers of two over the mean."""
    mean = sketch.mean() + 1.0
    return np.clip(np.floor(np.log2(np.maximum(sketch / (mean + 3 * np.sqrt(mean)), 1e-9))) + 1, 0, 15).astype(np.uint8)


def ordered(grams: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams in the global order, and their keys in it: class, then hash."""
    keys = (classes[counter(grams, len(classes).bit_length() - 1)].astype(np.uint64) << np.uint64(60)) | (grams >> np.uint64(4))
    by = np.argsort(keys, kind="stable")
    return grams[by], keys[by]


def prefixes(width: int, num: int, den: int, shared):
    """doc_id, size and the keys of the prefix of each set that the task meets, each set once."""

    def run(batches):
        seen, rows, held = set(), [], 0
        for doc, grams in in_chunks(batches, width):
            n = len(grams)
            if not n or doc is None or (key := set_key(grams)) in seen:
                continue
            seen.add(key)
            keys = ordered(grams, shared.value)[1][: n - -(-num * n // den) + 1]
            rows.append((doc, n, keys.tobytes()))
            held += len(keys)
            if held >= HELD:
                yield batch_of(rows, PREFIXES)
                rows, held = [], 0
        yield batch_of(rows, PREFIXES)

    return run


def by_fragment(bits: int):
    """The prefix n-grams of many documents, packed by fragment."""

    def packed(held):
        keys, docs, sizes, places = (np.concatenate(x) for x in zip(*held, strict=True))
        fragment = (keys >> np.uint64(60 - bits)).astype(np.int64)
        by = np.argsort(fragment, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(fragment[by]) > 0, True])
        return batch_of([(int(fragment[by[a]]), *(x[by[a:b]].tobytes() for x in (keys, docs, sizes, places))) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], POSTINGS)

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for doc, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                keys = np.frombuffer(raw, np.uint64)
                held.append((keys, np.full(len(keys), doc, np.int64), np.full(len(keys), n, np.int32), np.arange(len(keys), dtype=np.int32)))
                count += len(keys)
                if count >= HELD:
                    yield packed(held)
                    held, count = [], 0
        if held:
            yield packed(held)

    return run


def starred(num: int, den: int):
    """For each n-gram of a fragment that several documents of similar size have: the smallest of them and each other, once."""

    def stars(parts):
        keys, docs, sizes, places = (np.concatenate([np.frombuffer(p[k], t) for p in parts]) for k, t in enumerate((np.uint64, np.int64, np.int32, np.int32)))
        by = np.lexsort((docs, sizes, keys))
        keys, docs, sizes, places = keys[by], docs[by], sizes[by].astype(np.int64), places[by].astype(np.int64)
        # In the order of sizes a step too large for the threshold parts all before it from all behind.
        chain = np.cumsum(np.r_[True, (keys[1:] != keys[:-1]) | (sizes[:-1] * den < sizes[1:] * num)])
        by = np.lexsort((docs, chain))
        chain, docs, sizes, places = chain[by], docs[by], sizes[by], places[by]
        first = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
        length = np.diff(np.r_[first, len(chain)])
        lead = np.repeat(first, length)
        keep = docs != docs[lead]
        # Of two documents alone the sizes and the places of the n-gram bound the overlap.
        two = np.repeat(length, length) == 2
        reach = np.minimum(sizes - places, sizes[lead] - places[lead])
        keep &= ~two | (reach * (num + den) >= num * (sizes + sizes[lead]))
        pairs = np.unique(np.stack([docs[lead][keep], docs[keep]], 1), axis=0) if keep.any() else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=STARS)

    def run(batches):
        now, parts = None, []
        for batch in batches:
            for fragment, *blobs in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if fragment != now and parts:
                    yield stars(parts)
                    parts = []
                now = fragment
                parts.append(blobs)
        if parts:
            yield stars(parts)

    return run


def slots(ids: np.ndarray, bits: int) -> np.ndarray:
    """Two places of each id in the sieve."""
    x = ids.astype(np.int64).view(np.uint64)
    shift = np.uint64(64 - bits)
    return np.concatenate([finished(x + np.uint64(SEED)) >> shift, finished(x ^ np.uint64(0xD6E8FEB86659FD93)) >> shift]).astype(np.int64)


def sieve(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter for the ids of a column, of a size by their number: parts are merged by Spark, and SKETCH_PARTS rows of one size come here."""
    known = ids.where(F.col(column).isNotNull()).select(column)
    size = bits_for(known.count(), 4, SIEVE_BITS)
    width = (1 << size) // SKETCH_PARTS

    def placed(batches):
        for batch in batches:
            at = np.unique(slots(np.array(batch.column(0).to_pylist(), np.int64), size))
            part = at // width
            for k in np.unique(part).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(at[part == k] % width).astype(np.int32).tobytes()], pa.binary())], names=["part", "bits"])

    def merged(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(k, np.zeros(width, bool))[np.frombuffer(raw, np.int32)] = True
        for k, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])

    out = np.zeros((1 << size) // 8, np.uint8)
    for r in known.mapInArrow(placed, "part int, bits binary").repartition("part").mapInArrow(merged, "part int, bits binary").collect():
        out[r["part"] * width // 8 : (r["part"] + 1) * width // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def through(batch, packed: np.ndarray):
    """The rows of a batch whose first column may be among the ids of a sieve; a join that follows is exact."""
    known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    at = slots(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), len(packed).bit_length() + 2)
    found = (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return batch.filter(pa.array(known & found[: len(known)] & found[len(known) :]))


def sieved(rows: DataFrame, sieve_of) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield through(batch, sieve_of.value)

    return rows.mapInArrow(run, rows.schema)


def members(width: int, shared, sieve_of):
    """The whole sets, in the global order, of documents that a sieve lets through."""

    def run(batches):
        rows, held = [], 0
        for doc, grams in in_chunks((through(batch, sieve_of.value) for batch in batches), width):
            rows.append((doc, len(grams), ordered(grams, shared.value)[1].tobytes()))
            held += 8 * len(grams)
            if held >= 4 << 20:
                yield batch_of(rows, MEMBERS)
                rows, held = [], 0
        yield batch_of(rows, MEMBERS)

    return run


def stretches(sets: list[np.ndarray]) -> list[np.uint64]:
    """Where to cut the global order so that the sets have about STRETCH keys between two cuts: at keys of the largest set."""
    large, total = max(sets, key=len), sum(map(len, sets))
    return list(large[:: max(1, len(large) * STRETCH // max(1, total))][1:]) if total > STRETCH else []


def linked(sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Matrix of the pairs that reach the threshold, or may reach it if only the first keys of a set of ``sizes`` are given.

    Keys stand in the global order, which is cut into stretches and these into fragments; the overlaps of a fragment are
    counted separately and summed, so no more than a stretch is sorted at once. Of two sets cut short, the one whose keys
    end first bounds what they share behind that end.
    """
    m = len(sets)
    given = np.array([len(s) for s in sets], np.int64)
    need = num * (sizes[:, None] + sizes[None, :])
    tail, end = sizes - given, np.array([s[-1] for s in sets])
    behind = np.where(end[:, None] <= end[None, :], tail[:, None], tail[None, :])
    able = np.minimum(sizes[:, None], sizes[None, :]) * (num + den) >= need
    np.fill_diagonal(able, False)
    overlap = np.zeros((m, m), np.float32)
    at = np.zeros(m, np.int64)
    for cut_at in [*stretches(sets), None]:
        stop = given if cut_at is None else np.array([np.searchsorted(s, cut_at) for s in sets])
        owner = np.repeat(np.arange(m), stop - at)
        keys = np.concatenate([s[a:b] for s, a, b in zip(sets, at.tolist(), stop.tolist(), strict=True)])
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        common = count >= 2
        use = common[inverse]
        owner, column = owner[use], (np.cumsum(common) - 1)[inverse][use]
        by = np.argsort(column, kind="stable")
        owner, column = owner[by], column[by]
        # What is still to come: common keys of this stretch, and all keys behind it.
        left = np.bincount(owner, minlength=m) + given - stop
        shared = int(common.sum())
        for lo in range(0, shared, FRAGMENT):
            a, b = np.searchsorted(column, (lo, lo + FRAGMENT))
            x = np.zeros((m, min(FRAGMENT, shared - lo)), np.float32)
            x[owner[a:b], column[a:b] - lo] = 1
            overlap += x @ x.T
            left = left - np.bincount(owner[a:b], minlength=m)
            most = overlap.astype(np.int64) + np.minimum(left[:, None], left[None, :]) + behind
            able &= most * (num + den) >= need
            if not able.any():
                return np.zeros((m, m), bool)
        at = stop
    return able & (overlap > 0) & ((overlap.astype(np.int64) + behind) * (num + den) >= need)


def forest(link: np.ndarray) -> np.ndarray:
    """For each row the smallest row that links lead to."""
    label = np.arange(len(link))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(link)).min(1, initial=len(link)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def cells(num: int, den: int):
    """The forest of every cell; its members come together, sorted by cell and document."""

    def joined(rows):
        if len(rows) < 2:
            return []
        reps = np.array([r for r, _, _ in rows])
        label = forest(linked([np.frombuffer(g, np.uint64) for _, _, g in rows], np.array([n for _, n, _ in rows]), num, den))
        return [(int(reps[k]), int(reps[label[k]])) for k in np.flatnonzero(label != np.arange(len(label)))]

    def run(batches):
        now, rows, out = None, [], []
        for batch in batches:
            for *cell, rep, size, grams in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if cell != now:
                    out += joined(rows)
                    now, rows = cell, []
                if not rows or rows[-1][0] != rep:
                    rows.append((rep, size, grams))
            if len(out) > 4096:
                yield batch_of(out, FOREST)
                out = []
        yield batch_of(out + joined(rows), FOREST)

    return run


def compared(groups: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """node and component of what connects when the members of each group are compared by ``sets``."""
    placed = laid_out(groups, num, den)
    together = placed.join(sets, "rep").select("leader", "a", "b", "rep", "size", "grams").repartition("leader", "a", "b").sortWithinPartitions("leader", "a", "b", "rep")
    return connected_components(together.mapInArrow(cells(num, den), ddl(FOREST)))


def laid_out(groups: DataFrame, num: int, den: int) -> DataFrame:
    """(leader, a, b, rep): the cells of each group. Groups above a block are cut in the order of set sizes."""
    groups = groups.select("leader", "rep", "size")
    sized = by_class(groups, groups.groupBy("leader").agg(F.count("*").alias("members")), "leader", "members")
    small = sized.where(F.col("members") <= BLOCK).select("leader", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "rep")
    large = cut(sized.where(F.col("members") > BLOCK).drop("members"))
    if large.isEmpty():
        return small
    large = ranked(large, ["leader"], ["size", "rep"], "place").withColumn("block", F.floor((F.col("place") - 1) / BLOCK))
    large = cut(large)
    blocks = large.groupBy("leader", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    other = blocks.select("leader", F.col("block").alias("b"), F.col("low").alias("other_low"))
    pairs = blocks.withColumnRenamed("block", "a").join(other, "leader").where((F.col("a") <= F.col("b")) & (F.col("high") * den >= F.col("other_low") * num)).select("leader", "a", "b")
    sides = pairs.select("*", F.col("a").alias("block")).unionByName(pairs.where("a < b").select("*", F.col("b").alias("block")))
    return small.unionByName(large.join(sides, ["leader", "block"]).select("leader", "a", "b", "rep"))


def near_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = bits_for(rows.count(), 2, SKETCH_BITS)
    told = cut(rows.mapInArrow(summarised(width, bits), ddl(SETS)))
    sketch = np.zeros(1 << bits, np.uint32)
    size = len(sketch) // SKETCH_PARTS
    # SKETCH_PARTS rows: the sketch, at most 2 ** 24 counters.
    for r in told.where("part is not null").select("part", "counts").repartition("part").mapInArrow(summed, "part int, counts binary").collect():
        sketch[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint32)
    shared = spark.sparkContext.broadcast(rarity(sketch))
    sets = told.where("part is null").select("doc_id", "n_shingles", "set_key")
    reps = sets.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("many"))
    known = by_class(sets, reps, "set_key", "many")
    known = cut(known.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")))
    named = cut(known.where("rep is not null and n_shingles > 0").groupBy("doc_id").agg(F.min("rep").alias("rep"), F.min("n_shingles").alias("size")))
    fragments = max(4, (shuffle_parts(spark) - 1).bit_length() + 1)
    starts = cut(rows.mapInArrow(prefixes(width, num, den, shared), ddl(PREFIXES)))
    postings = starts.mapInArrow(by_fragment(fragments), ddl(POSTINGS)).repartition("fragment").sortWithinPartitions("fragment")
    stars = cut(postings.mapInArrow(starred(num, den), ddl(STARS)).distinct())
    leads, joins = named.select(F.col("doc_id").alias("leader"), F.col("rep").alias("lead")), named.withColumnRenamed("doc_id", "member")
    # A passage that very many documents share makes one of them the leader of them all.
    leaders = stars.groupBy("leader").agg(F.count("*").alias("many")).join(leads, "leader")
    met = by_class(stars, cut(leaders), "leader", "many").where("lead is not null").drop("many").join(joins, "member").where("rep <> lead").select(F.col("lead").alias("leader"), "rep", "size").distinct()
    met = cut(met)
    heads = met.select("leader").distinct().join(named.select(F.col("doc_id").alias("leader"), "size"), "leader").select("leader", F.col("leader").alias("rep"), "size")
    meeting = met.select("rep").unionByName(met.select(F.col("leader").alias("rep"))).distinct()
    # A class of copies may hold a third of all rows, so rows meet their class by ``by_class`` here and at the end.
    copies = known.groupBy("rep").agg(F.count("*").alias("many"))
    meeting = cut(meeting.join(copies, "rep").withColumn("meets", F.lit(True)))
    standing = cut(by_class(named.select("doc_id", "rep"), meeting, "rep", "many").where("meets").select("doc_id", "rep"))
    begun = sieved(starts, spark.sparkContext.broadcast(sieve(standing, "doc_id"))).join(standing, "doc_id").select("rep", "size", "grams")
    alive = compared(met.unionByName(heads), begun, num, den)
    alive = cut(alive.join(named.select(F.col("doc_id").alias("node"), "size"), "node").select(F.col("component").alias("leader"), F.col("node").alias("rep"), "size"))
    whole = rows.mapInArrow(members(width, shared, spark.sparkContext.broadcast(sieve(alive, "rep"))), ddl(MEMBERS))
    found = cut(compared(alive, whole, num, den).withColumnRenamed("node", "rep").join(copies, "rep"))
    return by_class(known, found, "rep", "many").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def first_documents(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the smallest doc_id; rows whose doc_id is null or
    repeated are documents of their own and stand behind all others."""
    rows = numbered(docs)
    keep = near_components(rows.select(F.col("__row").alias("doc_id"), "text"), width, num, den).where("doc_id = component_id").select(F.col("doc_id").alias("__keep"))
    return rows.join(keep, F.col("__row") == F.col("__keep"), "left_semi").drop("__row")
