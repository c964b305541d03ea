"""Exact deduplication with Patricia-trie owners.

Texts are dealt out by (byte length, content hash). Each such partition inserts its full byte strings into a
compressed radix trie whose terminal nodes own the text: they hold the identifier that stays and the count.
Two texts share a terminal only if every byte agrees, so a hash collision costs time, never a wrong result.

A trie beyond its limit spills a subtree into a scratch file of its own task, as Spark's sorts do: nobody else reads it,
a rerun of the task makes it anew, and it is gone when the task is. Only texts of equal length and hash share a trie, so
in practice that is one text each, and the limit is for collisions.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blobs

#: Bytes of labels that a trie holds before it spills its largest subtree.
TRIE_BYTES = 256 << 20
#: Bytes of distinct texts that a map task gathers before it sends them on.
MAP_BYTES = 48 << 20


def _shared(a: bytes, at: int, b: bytes) -> int:
    """Length of the common prefix of a[at:] and b, by halving."""
    low, high = 0, min(len(a) - at, len(b))
    if a[at : at + high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[at + low : at + mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class _Node:
    __slots__ = ("children", "label", "owner", "count", "spilled")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.owner, self.count, self.spilled = label, {}, None, 0, None


class PatriciaTrie:
    """A compressed radix trie from byte strings to (owner, count), which spills subtrees beyond ``limit`` bytes."""

    def __init__(self, better: Callable, limit: int = TRIE_BYTES) -> None:
        self.root, self.better, self.limit, self.held = _Node(b""), better, limit, 0

    def insert(self, text: bytes, owner, count: int = 1) -> None:
        node, at = self.root, 0
        while True:
            if node.spilled is not None:
                pickle.dump((text[at:], owner, count), node.spilled)
                return
            if at == len(text):
                node.owner = owner if not node.count else self.better(node.owner, owner)
                node.count += count
                if self.held > self.limit:
                    self._spill()
                return
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = _Node(text[at:])
                self.held += len(text) - at
            else:
                same = _shared(text, at, child.label)
                if same < len(child.label):
                    upper = _Node(child.label[:same])
                    child.label = child.label[same:]
                    upper.children[child.label[0]] = child
                    node.children[text[at]] = child = upper
            at += len(child.label)
            node = child

    def _spill(self) -> None:
        """Move what hangs below the largest child of the root to a file that later texts of that branch join."""
        open_ones = [x for x in self.root.children.values() if x.spilled is None]
        if not open_ones:
            self.held = 0
            return
        sizes = {id(x): sum(len(y.label) for _, y in _walk(x, b"")) for x in open_ones}
        node = max(open_ones, key=lambda x: sizes[id(x)])
        out = tempfile.TemporaryFile(prefix="subtree-")
        for suffix, x in _walk(node, b""):
            if x.count:
                pickle.dump((suffix, x.owner, x.count), out)
        self.held -= sizes[id(node)] - len(node.label)
        node.children, node.owner, node.count, node.spilled = {}, None, 0, out

    def items(self) -> Iterator[tuple[bytes, object, int]]:
        """Every text with its owner and count; spilled subtrees are built again, one at a time and within the limit.

        Each level of spilling takes at least a byte off all its texts and stands for more than ``limit`` bytes of them.
        """
        stack = [(self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            if node.spilled is not None:
                below = PatriciaTrie(self.better, self.limit)
                node.spilled.seek(0)
                while True:
                    try:
                        below.insert(*pickle.load(node.spilled))
                    except EOFError:
                        break
                node.spilled.close()
                for suffix, owner, count in below.items():
                    yield prefix + suffix, owner, count
                continue
            if node.count:
                yield prefix, node.owner, node.count
            stack.extend((x, prefix + x.label) for x in node.children.values())


def _walk(node: _Node, prefix: bytes) -> Iterator[tuple[bytes, _Node]]:
    """The nodes of a subtree that is in memory, with their text below ``node``."""
    stack = [(node, prefix)]
    while stack:
        x, p = stack.pop()
        yield p, x
        stack.extend((y, p + y.label) for y in x.children.values())


def _larger(a, b):
    return b if a is None or (b is not None and b > a) else a


def _smaller(a, b):
    return b if a is None or (b is not None and b < a) else a


_LOCAL = pa.schema([("n", pa.int64()), ("h", pa.int64()), ("body", pa.binary()), ("owner", pa.int64()), ("copies", pa.int64())])
_OWNED = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _pieces(rows: Iterator[tuple], schema: pa.Schema, body: int | None, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches bounded in rows and, by the column ``body``, in bytes."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[body]) + 48 if body is not None else 96
        if size > limit:
            yield _emit(out, schema)
            out, size = [], 0
    if out:
        yield _emit(out, schema)


def _runs(stream: Iterator[pa.RecordBatch], better: Callable, limit: int) -> Iterator[tuple]:
    """Rows ordered by (n, h): one trie for each run of equal keys, given as (n, h, text, owner, count)."""
    key, trie = None, None
    for batch in stream:
        for n, h, body, owner, copies in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if (n, h) != key:
                if trie is not None:
                    yield from ((*key, *x) for x in trie.items())
                key, trie = (n, h), PatriciaTrie(better, limit)
            trie.insert(body, owner, copies)
    if trie is not None:
        yield from ((*key, *x) for x in trie.items())


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_of: Callable[[Column], Column] = F.xxhash64, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id, group_size.

    Each map task first merges its own copies, so a text that a third of all rows share reaches the shuffle
    once per task and not once per row.
    """
    better = {"min": _smaller, "max": _larger}[keep]

    def local(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[tuple[int, int], PatriciaTrie] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            yield from _pieces(((*k, *x) for k, t in tries.items() for x in t.items()), _LOCAL, 2)

        for batch in stream:
            for n, h, body, owner in zip(*(batch.column(i).to_pylist() for i in (0, 1)), blobs(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                trie = tries.get((n, h))
                if trie is None:
                    trie = tries[n, h] = PatriciaTrie(better, trie_bytes)
                before = trie.held
                trie.insert(body, owner)
                held += max(0, trie.held - before) + 200
                if held > MAP_BYTES:
                    yield from flush()
                    tries, held = {}, 0
        yield from flush()

    def group(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs(stream, better, trie_bytes)
        yield from _pieces(((hashlib.sha256(body).hexdigest(), owner, copies) for _, _, body, owner, copies in runs), _OWNED, None)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.octet_length(text).cast("long").alias("n"), hash_of(text).cast("long").alias("h"), text.alias("body"), F.col(id_col).cast("long").alias("owner"))
    merged = rows.mapInArrow(local, "n long, h long, body binary, owner long, copies long")
    dealt = merged.repartition("n", "h").sortWithinPartitions("n", "h")
    return dealt.mapInArrow(group, "text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as the empty text, and all empty texts are one group. Of equal texts the smallest
    (``keep="max"``: largest) id stays; a null id stays only where no copy has an id. Rows that repeat both id and text are
    counted each, and all of them carry ``kept``. Other columns are ignored, whatever their names. No rows give no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))
    owned = owners(docs, id_col, text_col, keep, **options)
    return rows.join(owned, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
