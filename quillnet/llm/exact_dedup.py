"""Exact duplicates by Patricia-trie owners.

Texts are equal when they are identical after deleting white space. Partitions by length and content hash insert
the full byte strings into a compressed radix trie; the terminal node of a text holds its owner and its number of
rows. Every input task first does the same over its own rows, so a text that a third of all rows repeat reaches
the shuffle once for each task.

Defined results: null text counts as empty and all empty texts are equal; of equal texts the one with the most
code points in the original owns the group, then the smallest doc_id (a null doc_id loses to any other); repeated
rows count as members and share the owner's verdict; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import WHITE, by_class, cut, few_rows

#: Bytes of labels that a trie holds before its largest subtree leaves it.
TRIE_BYTES = 24 << 20
#: Rows and bytes of an output batch.
OUT_ROWS, OUT_BYTES = 4096, 8 << 20

ENTRY = "size long, hash long, body binary, chars long, doc_id long, copies long, settled boolean"


class Node:
    """A trie node: the bytes on the edge to it, its children by first byte, and the owner when a text ends here."""

    __slots__ = ("label", "kids", "chars", "doc", "copies")

    def __init__(self, label: bytes):
        self.label, self.kids, self.copies = label, {}, 0
        self.chars, self.doc = -1, None

    def own(self, chars: int, doc: int | None, copies: int) -> None:
        better = chars > self.chars or chars == self.chars and doc is not None and (self.doc is None or doc < self.doc)
        if better or not self.copies:
            self.chars, self.doc = chars, doc
        self.copies += copies


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Patricia:
    """A compressed radix trie over byte strings. ``spill`` takes the largest subtree out."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def insert(self, body: bytes, chars: int, doc: int | None, copies: int) -> None:
        node, at = self.root, 0
        while True:
            if at == len(body):
                node.own(chars, doc, copies)
                return
            kid = node.kids.get(body[at])
            if kid is None:
                kid = node.kids[body[at]] = Node(body[at:])
                self.held += len(kid.label) + 200
                kid.own(chars, doc, copies)
                return
            if body.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
                continue
            same = shared_prefix(kid.label, body[at : at + len(kid.label)])
            fork = Node(kid.label[:same])
            kid.label = kid.label[same:]
            fork.kids[kid.label[0]] = kid
            node.kids[body[at]] = fork
            self.held += 200
            node, at = fork, at + same

    def entries(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        todo = [(node or self.root, prefix)]
        while todo:
            x, before = todo.pop()
            body = before + x.label
            if x.copies:
                yield body, x
            todo.extend((k, body) for k in x.kids.values())

    def weight(self, node: Node) -> int:
        total, todo = 0, [node]
        while todo:
            x = todo.pop()
            total += len(x.label) + 200
            todo.extend(x.kids.values())
        return total

    def spill(self) -> Iterator[tuple[bytes, Node]]:
        """Takes out the heaviest subtree below the first fork and gives its texts."""
        node, prefix = self.root, b""
        while len(node.kids) == 1 and not node.copies:
            (kid,) = node.kids.values()
            if not kid.kids:
                break
            node, prefix = kid, prefix + kid.label
        if node.kids:
            heavy = max(node.kids.values(), key=self.weight)
            del node.kids[heavy.label[0]]
            self.held -= self.weight(heavy)
            yield from self.entries(heavy, prefix)
        else:
            yield from self.entries()
            self.root, self.held = Node(b""), 0

    def relieved(self, budget: int) -> Iterator[tuple[bytes, Node]]:
        """The texts of subtrees that leave a trie above the budget, until it holds half."""
        if self.held > budget:
            while self.held > budget // 2:
                yield from self.spill()


class Batches:
    """Collects entries into record batches of bounded size."""

    schema = pa.schema([("size", pa.int64()), ("hash", pa.int64()), ("body", pa.binary()), ("chars", pa.int64()), ("doc_id", pa.int64()), ("copies", pa.int64()), ("settled", pa.bool_())])

    def __init__(self):
        self.rows, self.bytes = [], 0

    def add(self, body: bytes, chars: int, doc: int | None, copies: int, settled: bool) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256(body).digest()
        self.rows.append((len(body), int.from_bytes(digest[:8], "big", signed=True), digest if settled else body, chars, doc, copies, settled))
        self.bytes += len(self.rows[-1][2])
        if len(self.rows) >= OUT_ROWS or self.bytes >= OUT_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), self.schema.types, strict=True)], schema=self.schema)
            self.rows, self.bytes = [], 0


def combined(budget: int):
    """The trie over one input task's rows; a subtree that must leave goes to the shuffle early, as it can be merged there."""

    def run(batches):
        trie, out = Patricia(), Batches()
        for batch in few_rows(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                trie.insert(b"".join(raw.split()), len(text or ""), doc, 1)
                for body, x in trie.relieved(budget):
                    yield from out.add(body, x.chars, x.doc, x.copies, False)
        for body, x in trie.entries():
            yield from out.add(body, x.chars, x.doc, x.copies, False)
        yield from out.flush()

    return run


def owners(budget: int):
    """The trie over a partition in the order of length and hash. Equal texts come together, so whatever the trie holds of
    earlier keys is complete: a trie above the budget gives up subtrees as settled when the next key comes, and a partition
    may hold any number of texts."""

    def run(batches):
        trie, out, now = Patricia(), Batches(), None
        for batch in few_rows(batches):
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("size", "hash", "body", "chars", "doc_id", "copies")]
            for size, hashed, body, chars, doc, copies in zip(*cols, strict=True):
                if (size, hashed) != now:
                    now = (size, hashed)
                    for full, x in trie.relieved(budget):
                        yield from out.add(full, x.chars, x.doc, x.copies, True)
                trie.insert(body, chars, doc, copies)
        for body, x in trie.entries():
            yield from out.add(body, x.chars, x.doc, x.copies, True)
        yield from out.flush()

    return run


def text_classes(docs: DataFrame, budget: int = TRIE_BYTES) -> DataFrame:
    """A row for each distinct text: text_sha256, keep_id, group_size."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.mapInArrow(combined(budget), ENTRY).repartition("size", "hash").sortWithinPartitions("size", "hash")
    done = cut(dealt.mapInArrow(owners(budget), ENTRY).select("body", "doc_id", "copies"))
    return done.select(F.lower(F.hex("body")).alias("text_sha256"), F.col("doc_id").alias("keep_id"), F.col("copies").alias("group_size"))


def exact_duplicates(docs: DataFrame, budget: int = TRIE_BYTES) -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    classes = text_classes(docs, budget)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), WHITE, ""), 256).alias("text_sha256"))
    told = by_class(named, classes, "text_sha256", "group_size")
    return told.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def kept_documents(docs: DataFrame, budget: int = TRIE_BYTES) -> DataFrame:
    """One row of ``docs`` for each distinct text, with all its columns: of the rows whose doc_id owns the text the longest, then by what the row holds."""
    classes = text_classes(docs, budget).select(F.col("keep_id").alias("__keep"), F.col("text_sha256").alias("__sha"), "group_size")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("__of", F.sha2(F.translate(text, WHITE, ""), 256))
    owned = lambda keep: rows.join(keep, (F.col("__of") == F.col("__sha")) & rows["doc_id"].cast("long").eqNullSafe(F.col("__keep")), "left_semi")
    # Only classes of several rows can hold a doc_id twice; their rows are combined before the shuffle.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = owned(classes.where("group_size > 1")).groupBy("__of").agg(F.min_by(row, F.struct(-F.length(text), F.sha2(F.to_json(row), 256))).alias("__row"))
    return owned(classes.where("group_size = 1")).drop("__of").unionByName(one.select("__row.*"))
