"""Exact deduplication by Patricia-trie owners.

Input partitions first combine their own copies in a trie, so a text that fills a third of all rows leaves each
partition once. The survivors are dealt by length and a short content hash, which many different texts may share, and
a second trie takes the full byte strings of one such group; its terminal nodes name the owners. Equality is so
decided on bytes. Groups come sorted, so a trie that grows too large can hand on what is below all but the last text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from carelake.shipping import ship

TRIE_BYTES = 64 << 20
#: Values of the short content hash by which texts of one length are dealt.
BUCKETS = 1 << 12
_PARTIAL = pa.schema(
    [("length", pa.int64()), ("bucket", pa.int64()), ("text", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())]
)
_OWNERS = pa.schema([("digest", pa.string()), ("owner", pa.int64()), ("n", pa.int64())])


class _Node:
    __slots__ = ("label", "children", "n", "owner")

    def __init__(self, label: bytes):
        self.label, self.children, self.n, self.owner = label, {}, 0, None


class PatriciaTrie:
    """A compressed radix trie over byte strings whose terminal nodes hold a count and an owner."""

    def __init__(self, largest: bool = True):
        self.root, self.held, self.pick = _Node(b""), {}, max if largest else min

    @property
    def size(self) -> int:
        return sum(self.held.values())

    def insert(self, text: bytes, owner: int | None, n: int = 1) -> None:
        """Add n copies of text; the owner is the largest (or smallest) identifier that is not null."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = _Node(text[at:])
                self.held[text[0]] = self.held.get(text[0], 0) + len(child.label) + 200
                at = len(text)
            elif text.startswith(child.label, at):
                at += len(child.label)
            else:
                child = self._split(node, child, _common(child.label, text, at))
                at += len(child.label)
            node = child
        node.n += n
        node.owner = owner if node.owner is None else node.owner if owner is None else self.pick(node.owner, owner)

    def _split(self, parent: _Node, child: _Node, k: int) -> _Node:
        upper = _Node(child.label[:k])
        child.label = child.label[k:]
        upper.children[child.label[0]] = child
        parent.children[upper.label[0]] = upper
        return upper

    def take(self, first: int | None = None) -> Iterator[tuple[bytes, int | None, int]]:
        """Remove and yield the terminals below one first byte, or of the whole trie."""
        stack = [(self.root.children.pop(first), b"")] if first is not None else [(self.root, b"")]
        if first is None:
            self.root, self.held = _Node(b""), {}
        else:
            self.held.pop(first)
        while stack:
            node, above = stack.pop()
            text = above + node.label
            if node.n:
                yield text, node.owner, node.n
            stack.extend((c, text) for c in node.children.values())

    def spill(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Remove and yield the largest subtree below the root."""
        return self.take(max(self.held, key=self.held.get))


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of label and text[at:], which differ somewhere within label."""
    lo, hi = 0, min(len(label), len(text) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if text.startswith(label[:mid], at):
            lo = mid
        else:
            hi = mid - 1
    return lo


def normalised(column: pa.Array) -> Iterator[bytes]:
    """Each text in UTF-8 with A-Z lower-cased; null counts as empty."""
    return ((x or "").encode().lower() for x in column.to_pylist())


def _rows(terminals, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for text, owner, n in terminals:
        held.append((len(text), zlib.crc32(text) % BUCKETS, text, owner, n))
        size += len(text) + 100
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _PARTIAL)], schema=_PARTIAL)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _PARTIAL)], schema=_PARTIAL)


def _combiner(largest: bool, trie_bytes: int):
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(largest)
        for batch in batches:
            for owner, text in zip(batch.column("doc_id").to_pylist(), normalised(batch.column("text"))):
                trie.insert(text, owner)
                while trie.size > trie_bytes:
                    yield from _rows(trie.spill())
        yield from _rows(trie.take())

    return combine


def _owners(largest: bool, trie_bytes: int):
    """Sorted partials to one owner per text, from one trie for each group of a length and a short hash."""

    def table(rows: list[tuple[str, int | None, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OWNERS)], schema=_OWNERS)

    def emptied(trie: PatriciaTrie) -> Iterator[tuple[str, int | None, int]]:
        return ((hashlib.sha256(text).hexdigest(), owner, n) for text, owner, n in trie.take())

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now, last = PatriciaTrie(largest), None, None
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("length", "bucket", "text", "owner", "n"))
            for length, bucket, text, owner, n in zip(*columns):
                # In byte order a new text closes all before it, so a full trie may be emptied then.
                if now != (length, bucket) or (trie.size > trie_bytes and text != last):
                    out.extend(emptied(trie))
                now, last = (length, bucket), text
                trie.insert(text, owner, n)
            if out:
                yield table(out)
        if now is not None:
            yield table(list(emptied(trie)))

    return own


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = pa.array([hashlib.sha256(x).hexdigest() for x in normalised(batch.column("text"))], pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), digests], names=["doc_id", "text_sha256"]
        )


def exact_duplicates(docs: DataFrame, largest: bool = True, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when their bytes are, after lower-casing A-Z only; null counts as empty. Of equal texts the
    largest doc_id owns the group (or the smallest). A null doc_id owns only a group without other ids. Rows that
    repeat a doc_id within a group are each counted, and each kept if that id owns it. Extra columns are ignored.
    An empty table gives an empty result. An input partition's trie over trie_bytes hands its largest subtree on to the
    shuffle.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    partial = docs.mapInArrow(
        _combiner(largest, trie_bytes), "length long, bucket long, text binary, owner long, n long"
    )
    dealt = partial.repartition("length", "bucket").sortWithinPartitions("length", "bucket", "text")
    owners = dealt.mapInArrow(_owners(largest, trie_bytes), "digest string, owner long, n long")
    each = docs.mapInArrow(_digests, "doc_id long, text_sha256 string")
    return each.join(owners, each.text_sha256 == owners.digest).select(
        "doc_id",
        F.col("owner").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("owner")).alias("kept"),
        "text_sha256",
    )
