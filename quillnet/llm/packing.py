"""Best-fit packing of token sequences after dominance reduction.

Every document becomes its token ids and an end id; longer ones than a sequence are cut into full pieces and a
rest. Bin packing only asks for lengths, so the instance is a histogram of at most ``capacity`` lengths, whatever
the number of documents. On it the Martello-Toth reduction fixes, from the largest length down, the sets that
provably dominate every other set holding that item: it alone if nothing fits with it, or with the one partner
that no other choice can beat. What is left is packed best fit, largest first. Both work on counts, so the plan is
a list of bin contents with multiplicities; pieces find their bin by their rank among those of equal length.

Ids are those of the tokenizer file. Its merges are applied by byte ranks, which keeps no state between texts; this is
checked when the file is read (every token must be reachable, the rules for case and pieces as expected, classes and
lower case of each code point asked from the tokenizer). Another file, and texts with code points or very long pieces
that the check does not cover, go through the tokenizer itself.

Defined results: null text is empty and gives the end id alone; a table without rows gives no pieces; repeated rows
are packed each on its own; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import cut, ranked

CAPACITY, END = 4096, 1
PIECE = "doc_id long, piece long, start long, length long, ids_crc32 long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Characters classed at once, and the longest piece left to the byte ranks.
CHUNK, LONGEST = 1 << 19, 400
#: Classes of code points; NOT_PLAIN leaves a text to the tokenizer itself.
SPACE, LETTER, NUMBER, MARK, NOT_PLAIN = 0, 1, 2, 3, 9
#: Blocks whose code points are classed: Latin, Greek and Cyrillic, punctuation, kana, Han, Hangul, full-width forms.
BLOCKS = ((0x0, 0x250), (0x370, 0x530), (0x2000, 0x2070), (0x20A0, 0x20C0), (0x3000, 0x3100), (0x4E00, 0x9FFF), (0xAC00, 0xD7A4), (0xFF01, 0xFF5F))
# What a tokenizer file must say for its vocabulary to be read as byte ranks with word ends.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TAILS = ("s", "t", "re", "ve", "m", "ll", "d")
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_END = "</w>"
BLANK = re.compile(r"[\x20\n]")
_ready: dict[str, tuple] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_of() -> dict[str, int]:
    """The byte each symbol of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """The vocabulary over bytes; a word's end is written as a blank, which no piece holds."""
    known = byte_of()
    return {bytes(known[c] for c in t.removesuffix(WORD_END)) + (b" " if t.endswith(WORD_END) else b""): k for t, k in vocabulary.items()}


def reachable(vocabulary: dict[str, int], merges: list) -> bool:
    """Whether merging leads from every token's symbols to the token.

    Then the two parts that a token last consists of are always those of its merge, and joining neighbours by the rank of what
    they form, as byte ranks do, is the same as joining them by the rank of the pair.
    """
    order = {tuple(m): k for k, m in enumerate(merges)}
    if [vocabulary["".join(m)] for m in merges] != list(range(len(vocabulary) - len(merges), len(vocabulary))):
        return False
    for token in vocabulary:
        bare = token.removesuffix(WORD_END)
        parts = [*bare[:-1], bare[-1] + token[len(bare) :]]
        while len(parts) > 1:
            rank, at = min((order.get(pair, len(order)), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(order):
                return False
            parts[at : at + 2] = ["".join(parts[at : at + 2])]
        if parts != [token]:
            return False
    return True


@functools.lru_cache(4)
def classed(path: str) -> tuple[np.ndarray, np.ndarray] | None:
    """For each code point below 65536 its class and its lower case, as the tokenizer itself gives them; None if its file
    is of another form than byte ranks can follow."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, normal, split = told["model"], told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    steps = split.get("pretokenizers") or [{}, {}]
    plain = (
        model.get("type") == "BPE" and model.get("end_of_word_suffix") == WORD_END and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and normal.get("normalizers") == NORMAL and len(steps) == 2 and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
        and steps[1].get("type") == "ByteLevel" and steps[1].get("add_prefix_space") is False and steps[1].get("use_regex") is False
        and all(t["special"] and t["content"].startswith("<|") for t in told["added_tokens"]) and len(model["vocab"]) - len(model["merges"]) == 512
    )
    if not plain or not reachable(model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]):
        return None
    tokenizer = Tokenizer.from_file(path)
    kind, low = np.full(1 << 16, NOT_PLAIN, np.uint8), np.zeros(1 << 16, np.uint16)
    count = lambda s: len(tokenizer.pre_tokenizer.pre_tokenize_str(s))
    for c in (c for a, b in BLOCKS for c in range(a, b)):
        x = chr(c)
        if x.isspace() and unicodedata.normalize("NFC", x) == x:
            if tokenizer.normalizer.normalize_str(f"a{x}a") == "a a":
                kind[c], low[c] = SPACE, 32
            continue
        lower = tokenizer.normalizer.normalize_str(x)
        # A code point that joins others or becomes several is left to the tokenizer.
        if unicodedata.normalize("NFC", x) != x or len(lower) != 1 or unicodedata.combining(x) or ord(lower) >= 1 << 16:
            continue
        parts = count(f"a{lower}a")
        kind[c], low[c] = LETTER if parts == 1 else SPACE if parts == 2 else NUMBER if count(lower * 2) == 2 else MARK, ord(lower)
    kind[ord("<")] = NOT_PLAIN if any(t["content"][0] == "<" for t in told["added_tokens"]) else kind[ord("<")]
    return kind, low


def engines(path: str):
    """A worker's tokenizer and, over the same file, its byte ranks."""
    if path not in _ready:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"].get("vocab")
        ranks = byte_ranks(vocabulary) if isinstance(vocabulary, dict) and "!" + WORD_END in vocabulary else {}
        closes = np.zeros(max(ranks.values(), default=0) + 1, bool)
        closes[[k for t, k in ranks.items() if t.endswith(b" ") and len(t) > 1]] = True
        _ready[path] = Tokenizer.from_file(path), tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}) if ranks else None, closes
    return _ready[path]


class Chunk:
    """The pieces of several parts of texts, in lower case, one after another without what lies between them.

    ``left`` are the parts that byte ranks cannot follow; they have no pieces here.
    """

    def __init__(self, parts: list[str], kind: np.ndarray, low: np.ndarray):
        codes = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        near = np.minimum(codes, (1 << 16) - 1).astype(np.uint16)
        k, c = kind[near], low[near]
        ends = np.cumsum([len(p) + 1 for p in parts])
        self.left: set[int] = set()
        self.drop(np.flatnonzero((k == NOT_PLAIN) | (codes >= 1 << 16)), k, ends)
        while True:
            begins = (k != SPACE) & ((k != np.r_[np.uint8(SPACE), k[:-1]]) | (k == NUMBER))
            # A mark that begins with an apostrophe before one of the tails is a piece with that tail.
            for at in np.flatnonzero(begins & (c == ord("'")) & (k == MARK)).tolist():
                after = c[at + 1 : at + 3].astype(np.uint32).tobytes().decode("utf-32-le")
                tail = next((t for t in TAILS if after.startswith(t)), None)
                if tail:
                    begins[at + 1] = False
                    if at + 1 + len(tail) < len(k) and k[at + 1 + len(tail)] == LETTER:
                        begins[at + 1 + len(tail)] = True
            solid = np.flatnonzero(k != SPACE)
            self.start = np.flatnonzero(begins[solid])
            self.size = np.diff(np.r_[self.start, len(solid)])
            long = self.size > LONGEST
            if not long.any():
                break
            self.drop(solid[self.start[long]], k, ends)
        self.chars = c[solid]
        self.per_part = np.diff(np.r_[0, np.searchsorted(solid[self.start], ends)])

    def drop(self, places: np.ndarray, k: np.ndarray, ends: np.ndarray) -> None:
        for n in np.unique(np.searchsorted(ends, places, "right")).tolist():
            self.left.add(n)
            k[ends[n - 1] if n else 0 : ends[n] - 1] = SPACE

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of pieces that stand for all equal ones, and which of them each piece has. Equal hashes are compared."""
        owner = np.repeat(np.arange(len(self.start)), self.size)
        place = np.arange(len(self.chars)) - self.start[owner]
        mixed = (self.chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * (2 * place + 1).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        _, first, which = np.unique(np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), self.start), return_index=True, return_inverse=True)
        rep = first[which]
        if (self.size == self.size[rep]).all() and (self.chars == self.chars[self.start[rep][owner] + place]).all():
            return first, which
        return np.arange(len(self.start)), np.arange(len(self.start))

    def ids(self, ranks, closes: np.ndarray) -> list[np.ndarray]:
        """The ids of each part; distinct pieces are encoded once."""
        if not len(self.start):
            return [np.zeros(0, np.uint32)] * len(self.per_part)
        first, which = self.distinct()
        size = self.size[first]
        shift = np.cumsum(size + 1) - size - 1
        text = np.full(int(size.sum()) + len(size), 32, np.uint32)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(shift, size) + within] = self.chars[np.repeat(self.start[first], size) + within]
        found = ranks.encode_to_numpy(text.tobytes().decode("utf-32-le"), disallowed_special=())
        stop = np.flatnonzero(closes[found]) + 1
        count = np.diff(np.r_[0, stop])
        n = count[which]
        total = np.cumsum(n)
        out = found[np.arange(int(n.sum())) + np.repeat((stop - count)[which] - (total - n), n)]
        return np.split(out.astype(np.uint32, copy=False), np.r_[0, total][np.cumsum(self.per_part)[:-1]])


def token_ids(texts: list[str], path: str, table: tuple[np.ndarray, np.ndarray] | None) -> list[np.ndarray]:
    """The ids of whole texts. Long ones are cut at white space, over which no piece reaches; where byte ranks cannot
    follow the tokenizer, the tokenizer itself encodes the part."""
    tokenizer, ranks, closes = engines(path)
    direct = lambda parts: [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch(parts, add_special_tokens=False)]
    if table is None:
        return direct(texts)
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held, chars = [], 0

    def flush() -> None:
        chunk = Chunk([p for _, p in held], *table)
        found = chunk.ids(ranks, closes)
        left = sorted(chunk.left)
        for n, ids in zip(left, direct([held[n][1] for n in left]) if left else [], strict=True):
            found[n] = ids
        for (owner, _), ids in zip(held, found, strict=True):
            out[owner].append(ids)
        held.clear()

    for owner, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > CHUNK:
                blank = BLANK.search(text, at + CHUNK)
                end = blank.end() if blank else end
            held.append((owner, text[at:end]))
            chars += end - at
            at = end
            if chars >= CHUNK:
                flush()
                chars = 0
    if held:
        flush()
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]


def cut_pieces(path: str, capacity: int, end: int, table):
    def run(batches):
        last = np.array([end], np.uint32)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                few, out = batch.slice(begin, 1024), ([], [], [], [], [])
                for doc, ids in zip(few.column(0).to_pylist(), token_ids([t or "" for t in few.column(1).to_pylist()], path, table.value), strict=True):
                    ids = np.concatenate([ids, last]).astype("<u4", copy=False)
                    for k, lo in enumerate(range(0, len(ids), capacity)):
                        piece = ids[lo : lo + capacity]
                        for col, x in zip(out, (doc, k, lo, len(piece), zlib.crc32(piece.data)), strict=True):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class Stock:
    """Lengths that are left, as counts, in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            del self.sizes[bisect.bisect_left(self.sizes, size)]

    def fits(self, room: int, used: dict[int, int]) -> int | None:
        """The largest length up to ``room`` with an item besides the ``used`` ones."""
        i = bisect.bisect_right(self.sizes, room) - 1
        while i >= 0:
            if self.n[self.sizes[i]] > used.get(self.sizes[i], 0):
                return self.sizes[i]
            i -= 1
        return None

    def smallest(self, k: int, used: dict[int, int]) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), self.n[s] - used.get(s, 0))
            if len(out) >= k:
                break
        return out


def dominating(stock: Stock, big: int, capacity: int) -> tuple[int, ...] | None:
    """Lengths to put beside ``big`` in one bin so that the set dominates every feasible set with ``big``; None if unproven.

    A set dominates when whatever else could stand beside ``big`` fits in the places of its members. One partner is
    proven when it fills the bin, when no two others fit, or when three do not fit and the best two are no longer
    than it. Two partners are proven when three do not fit and every pair that fits can stand in their places.
    """
    room, used = capacity - big, {big: 1}
    one = stock.fits(room, used)
    if one is None:
        return ()
    if one == room:
        return (one,)
    low = stock.smallest(3, used)
    if len(low) < 2 or low[0] + low[1] > room:
        return (one,)
    if len(low) == 3 and sum(low) <= room:
        return None
    best, firm = 0, True
    second = stock.fits(room - one, used | {one: used.get(one, 0) + 1})
    for a in reversed(stock.sizes[: bisect.bisect_right(stock.sizes, room)]):
        if 2 * a < best:
            break
        if stock.n[a] > used.get(a, 0) and (b := stock.fits(min(a, room - a), used | {a: used.get(a, 0) + 1})) is not None:
            best = max(best, a + b)
            firm = firm and second is not None and (b <= second or a + b <= one)
    if best <= one:
        return (one,)
    return (one, second) if firm and second is not None else None


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Bins that are fixed by dominance, as (lengths, how many), and the counts of what is left."""
    stock, fixed = Stock(counts), []
    hard: list[int] = []
    at = capacity
    while (i := bisect.bisect_right(stock.sizes, at) - 1) >= 0:
        big = stock.sizes[i]
        beside = dominating(stock, big, capacity)
        if beside is None:
            hard.append(big)
            at = big - 1
            continue
        need: dict[int, int] = {}
        for s in (big, *beside):
            need[s] = need.get(s, 0) + 1
        # The proof holds for each further item as long as the partners last: what is left only shrinks.
        k = min(stock.n[s] // c for s, c in need.items())
        fixed.append(((big, *beside), k))
        for s, c in need.items():
            stock.take(s, k * c)
    return fixed, dict(stock.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Bins as (((length, how often), ...), how many): best fit by decreasing length, items of one length at a time."""
    rooms: dict[int, list] = {}  # room -> [(content, how many)]
    order: list[int] = []

    def put(room: int, content: tuple, many: int) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append((content, many))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect.bisect_left(order, size)
            if i == len(order):
                each = capacity // size
                whole, rest = divmod(left, each)
                if whole:
                    put(capacity - each * size, ((size, each),), whole)
                if rest:
                    put(capacity - rest * size, ((size, rest),), 1)
                break
            room = order[i]
            content, many = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                del order[i]
            each = room // size
            whole = min(many, left // each)
            if whole:
                put(room - each * size, (*content, (size, each)), whole)
                left -= whole * each
            if whole < many:
                if left and left < each:
                    put(room - left * size, (*content, (size, left)), 1)
                    whole, left = whole + 1, 0
                if whole < many:
                    put(room, content, many - whole)
    return [x for group in rooms.values() for x in group]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, items of the run in a sequence, offset there).

    Full pieces and dominance come first, then best fit. The number of runs depends on the lengths there are."""
    fixed, rest = reduced(counts, capacity)
    bins = []
    for lengths, many in fixed:
        content: dict[int, int] = {}
        for s in lengths:
            content[s] = content.get(s, 0) + 1
        bins.append((tuple(content.items()), many))
    bins += best_fit(rest, capacity)
    runs, given, sequence = [], dict.fromkeys(counts, 0), 0
    for content, many in bins:
        at = 0
        for size, each in content:
            runs.append((size, given[size], given[size] + each * many, sequence, each, at))
            given[size] += each * many
            at += each * size
        sequence += many
    return runs


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids in pieces of at most ``capacity``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = path or default_vocabulary()
    table = docs.sparkSession.sparkContext.broadcast(classed(path))  # two numbers for each of 65536 code points
    return rows.mapInArrow(cut_pieces(path, capacity, end, table), PIECE)


def located(shared):
    """Gives each piece its sequence and offset, by binary search among the runs in the order of length and first rank."""
    shift = np.int64(1) << np.int64(48)

    def run(batches):
        size, first, _, sequence, each, at = shared.value
        keys = size * shift + first
        for batch in batches:
            length, place = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "place"))
            k = np.searchsorted(keys, length * shift + place, "right") - 1
            nth = place - first[k]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([cols[0], cols[1].cast(pa.int32()), *cols[2:], pa.array(sequence[k] + nth // each[k]), pa.array(at[k] + nth % each[k] * length)], names=[c.split()[0] for c in PLACED.split(", ")])

    return run


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset."""
    cutup = cut(pieces(docs, path, capacity, end))
    counts = {r["length"]: r["count"] for r in cutup.groupBy("length").count().collect()}  # at most ``capacity`` rows
    placed = ranked(cutup, ["length"], ["doc_id", "piece"], "place").withColumn("place", F.col("place") - 1)
    # The runs depend on the lengths, not on the documents: a few for each of at most ``capacity`` lengths.
    runs = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6).T
    return placed.mapInArrow(located(docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(runs))), PLACED)
