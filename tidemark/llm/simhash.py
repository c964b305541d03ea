"""SimHash near-duplicates, linked by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a common variant within half the radius of each. Every distinct
fingerprint therefore stands for all its variants of that ball. They are shuffled by the leading bits of the
variant: a fingerprint goes once to each leading part that its variants have, and its variants with that
leading part are written out there, sorted, and compared. Fingerprints that share a variant are within twice
half the radius of each other, so each collision is checked by its distance and joined to the least
fingerprint of the variant; no pairs within a group are listed.

``near_duplicates`` links whatever is within the radius. ``similar_copies`` asks for a similarity of the shingle sets
instead: several tables of shorter fingerprints give candidates by the same balls, and each is verified on all shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, blobs, cut, few_rows
from .components import connected_components, meet

#: Variants that a shuffle partition should hold, and that a task holds at a time.
PART_VARIANTS, LEAF_VARIANTS = 8_000_000, 300_000
_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the lower-cased word shingles, repeats included; of the whole sequence if it is shorter."""
    tokens = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    if len(tokens) < words:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    return np.array([digest(line[s:e], 42) for s, e in zip(starts, ends, strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have set; zero for none."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 32768):
        part = hashes[i : i + 32768].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = 4) -> int:
    """The 64-bit SimHash of one text."""
    return majority(shingle_hashes(text, words))


def _again(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash of each shingle, from its first one."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp) per row; null and wordless texts get fingerprint zero."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = np.array([fingerprint(x, words) for x in blobs(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], schema=_FP)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(bits: int, radius: int) -> np.ndarray:
    """All values below 2**bits with at most ``radius`` bits set."""
    found = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return np.array(found, np.uint64)


def _leaves(value: np.ndarray, owner: np.ndarray, left: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Halve by the next leading bit until the variants of a part fit; those who differ there spend one flip."""
    counts = np.bincount(left, minlength=1)
    size = sum(int(n) * sum(comb(bits, i) for i in range(r + 1)) for r, n in enumerate(counts))
    if size <= LEAF_VARIANTS or bits <= 16 or len(value) < 2:
        if len(value) > 1:
            yield value, owner, left, bits
        return
    bit = np.uint64(1 << (bits - 1))
    for want in (np.uint64(0), bit):
        same = (value & bit) == want
        stay = same | (left > 0)
        yield from _leaves(np.where(same, value, value ^ bit)[stay], owner[stay], (left - ~same)[stay], bits - 1)


def _variants(value: np.ndarray, owner: np.ndarray, left: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All variants of each value within the flips it has left, and whose they are."""
    variants, owners = [], []
    for k in range(int(left.max()) + 1):
        at = np.flatnonzero(left == k)
        masks = _masks(bits, k)
        variants.append((value[at][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(owner[at], len(masks)))
    return np.concatenate(variants), np.concatenate(owners)


class _Union:
    """Union by least member over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def collide(fps: np.ndarray, prefix: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least linked one) among those whose variants start with the ``bits`` bits of ``prefix``."""
    fps = np.unique(fps)
    half = radius // 2
    low = 64 - bits
    apart = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(prefix)).astype(np.int64) if bits else np.zeros(len(fps), np.int64)
    near = apart <= half
    fps, left = fps[near], half - apart[near]
    value = fps & np.uint64((1 << low) - 1)
    union = _Union(len(fps))
    for v, o, r, b in _leaves(value, np.arange(len(fps)), left, low):
        variant, who = _variants(v, o, r, b)
        order = np.argsort(variant, kind="stable")
        variant, who = variant[order], who[order]
        again = np.flatnonzero(variant[1:] == variant[:-1]) + 1
        if not len(again):
            continue
        first = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1])))
        head = who[first[np.searchsorted(first, again, "right") - 1]]
        pairs = np.unique(head * len(fps) + who[again])
        x, y = pairs // len(fps), pairs % len(fps)
        good = np.bitwise_count(fps[x] ^ fps[y]) <= radius
        for i, j in zip(x[good].tolist(), y[good].tolist(), strict=True):
            union.join(i, j)
    root = np.array([union.find(i) for i in range(len(fps))], np.int64)
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def _by_key(stream: Iterator[pa.RecordBatch], done: Callable[[int, list[bytes]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, body) in the order of the key: what ``done`` makes of all bodies of each key."""
    now, bodies = None, []
    for batch in stream:
        for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != now:
                if bodies:
                    yield done(now, bodies)
                now, bodies = key, []
            bodies.append(body)
    if bodies:
        yield done(now, bodies)


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): enough links between the distinct fingerprints ``fp`` to give the components at ``radius`` bits.

    ``radius`` is even: half of it is the ball that each fingerprint stands for. The number of leading bits follows the
    number of fingerprints, so that partitions stay of one size however many there are.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    half = radius // 2
    ball = sum(comb(64, i) for i in range(half + 1))
    bits = min(24, max(4, (fps.count() * ball // PART_VARIANTS).bit_length()))
    spread = _masks(bits, half)

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            fp = batch.column(0).to_numpy().view(np.uint64)
            if not len(fp):
                continue
            prefix = ((fp >> np.uint64(64 - bits))[:, None] ^ spread[None, :]).ravel()
            order = np.argsort(prefix, kind="stable")
            prefix, value = prefix[order], np.repeat(fp, len(spread))[order]
            first = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
            parts = [x.tobytes() for x in np.split(value, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(prefix[first].astype(np.int64)), pa.array(parts, pa.binary())], names=["prefix", "body"])

    def done(prefix: int, bodies: list[bytes]) -> pa.RecordBatch:
        a, b = collide(np.frombuffer(b"".join(bodies), np.uint64), prefix, bits, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    dealt = fps.select("fp").mapInArrow(deal, "prefix long, body binary").repartition("prefix").sortWithinPartitions("prefix")
    return dealt.mapInArrow(lambda stream: _by_key(stream, done), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Documents are linked if their fingerprints differ in at most ``radius`` bits. Null, empty and wordless texts
    have fingerprint zero and are linked like any other; rows that repeat an id stay rows of their own. A null id
    never names a component unless nothing else is in it. No rows give no rows.
    """
    marked = cut(fingerprints(docs, id_col, text_col, words))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = connected_components(links(distinct, radius)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = meet(rooted, named, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The similarity of shingle sets, as a fraction.
SHARE = (4, 5)
#: Width of a fingerprint of ``similar_copies`` and how many it has. At the least similarity a bit differs with a
#: chance of 0.15, so one table has a pair within four bits with a chance of 0.25, and one of these with 0.99. Chance pairs
#: are 1e-7 of all; for 1e9 documents and more take 48 bits and 32 tables, which have a hundredth of them.
WIDTH, TABLES = 40, 16


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, words))


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """If two sets have at least the similarity."""
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same * SHARE[1] >= SHARE[0] * (len(x) + len(y) - same)


def table_fingerprints(shingles: np.ndarray, width: int, tables: int) -> np.ndarray:
    """``tables`` independent fingerprints of ``width`` bits of one set of shingle hashes."""
    words = -(-width * tables // 64)
    votes = np.zeros((words, 64), np.int64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096]
        each = np.stack([_again(part, k) if k else part for k in range(words)]).astype("<u8")
        votes += np.unpackbits(each.view(np.uint8).reshape(words, len(part), 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int32)
    bits = (votes * 2 > len(shingles)).ravel()[: width * tables].reshape(tables, width)
    padded = np.zeros((tables, 64), bool)
    padded[:, :width] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").ravel()


#: Variants of one table that a part of ``candidates`` holds, about: its task takes some twenty seconds, whatever the input.
PART_TABLE_VARIANTS = 256_000_000
#: Share of all fingerprint bits up to which a candidate is verified, some four deviations beyond the least similarity; a wider
#: one for sets of fewer shingles than ``FEW``, whose bits differ more.
MOST_APART, FEW, MOST_APART_FEW = 0.205, 20, 0.28


def _meetings(fps: np.ndarray, prefix: int, bits: int, radius: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``fps`` by shared variant, group after group, with where each group starts and its size; groups of one are left out."""
    low = width - bits
    left = radius // 2 - np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(prefix)).astype(np.int64)
    for v, o, r, b in _leaves(fps & np.uint64((1 << low) - 1), np.arange(len(fps)), left, low):
        variant, who = _variants(v, o, r, b)
        order = np.argsort(variant)
        variant, who = variant[order], who[order]
        again = np.concatenate(([False], variant[1:] == variant[:-1]))
        again[:-1] |= again[1:]
        variant, who = variant[again], who[again]
        if len(who):
            first = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1])))
            yield who, first, np.diff(np.concatenate((first, [len(who)])))


def _distinct(fps: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct fingerprints, all nodes in their order, where those of each start, and how many they are."""
    order = np.lexsort((nodes, fps))
    fps, nodes = fps[order], nodes[order]
    first = np.flatnonzero(np.concatenate(([True], fps[1:] != fps[:-1])))
    return fps[first], nodes, first, np.diff(np.concatenate((first, [len(fps)])))


def attached(fps: np.ndarray, nodes: np.ndarray, prefix: int, bits: int, radius: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, partners and distances: each node with the most central one whose ball shares a variant with its own, among variants that start with ``prefix``.

    The one that shares most variants is the most central: the text that the others are copies of is near to more of them
    than any copy is. Nodes of one fingerprint are linked to the least of them, which stands for them all.
    """
    places = _distinct(fps, nodes)
    return _central(*places, list(_meetings(places[0], prefix, bits, radius, width)), prefix, bits, width)


def _central(fps: np.ndarray, nodes: np.ndarray, at: np.ndarray, many: np.ndarray, met: list, prefix: int, bits: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # only the part that a fingerprint itself belongs to tells of its equals
    same = np.repeat((fps >> np.uint64(width - bits)) == np.uint64(prefix), many)
    same[at] = False
    out = [(nodes[same], np.repeat(nodes[at], many)[same], np.zeros(same.sum(), np.int64))]
    nodes = nodes[at]
    shared = np.zeros(len(fps))
    for who, _, size in met:
        shared += np.bincount(who, np.repeat(size, size), len(fps))
    order = np.lexsort((nodes, -shared))
    rank = np.empty(len(fps), np.int64)
    rank[order] = np.arange(len(fps))
    best = rank.copy()
    for who, first, size in met:
        np.minimum.at(best, who, np.repeat(np.minimum.reduceat(rank[who], first), size))
    moved = best < rank
    to = order[best[moved]]
    out.append((nodes[moved], nodes[to], np.bitwise_count(fps[moved] ^ fps[to]).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


#: Nodes that may share a variant, and fingerprints that one may meet in a part, before they count as crowded.
CROWD, MEETS = 4, 8


def _uncrowded(fps: np.ndarray, nodes: np.ndarray, at: np.ndarray, many: np.ndarray, met: list, prefix: int, bits: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of nodes that meet and aren't both crowded, as two arrays; and the crowded nodes, who share a variant with many.

    Pairs of a variant are listed only where few share it, so their number grows with the rows.
    """
    crowded = many > CROWD
    totals = [np.add.reduceat(many[who], first) for who, first, _ in met]
    for (who, _, size), total in zip(met, totals, strict=True):
        crowded[who[np.repeat(total > CROWD, size)]] = True
    found = []
    for (who, first, size), total in zip(met, totals, strict=True):
        for k in np.unique(size[total <= CROWD]).tolist():
            group = who[first[(size == k) & (total <= CROWD)][:, None] + np.arange(k)]
            i, j = np.triu_indices(k, 1)
            x, y = group[:, i].ravel(), group[:, j].ravel()
            one = ~(crowded[x] & crowded[y])
            found.append(np.unique(np.minimum(x, y)[one] * len(fps) + np.maximum(x, y)[one]))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    x, y = pairs // len(fps), pairs % len(fps)
    crowded |= np.bincount(np.concatenate([x, y]), minlength=len(fps)) > MEETS
    one = ~(crowded[x] & crowded[y])
    x, y = x[one], y[one]
    # every node of the one with every node of the other
    size = many[x] * many[y]
    x, y, k = np.repeat(x, size), np.repeat(y, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    a, b = [nodes[at[x] + k // many[y]]], [nodes[at[y] + k % many[y]]]
    equal = np.repeat(np.where(~crowded & ((fps >> np.uint64(width - bits)) == np.uint64(prefix)), np.arange(len(fps)), -1), many)
    for k in range(1, min(CROWD, len(nodes))):
        same = np.flatnonzero((equal[k:] == equal[:-k]) & (equal[k:] >= 0))
        a.append(nodes[same + k])
        b.append(nodes[same])
    return np.concatenate(a), np.concatenate(b), nodes[np.repeat(crowded, many)]


def across(fps: np.ndarray, nodes: np.ndarray, roots: np.ndarray, seed: int, prefix: int, bits: int, radius: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, partners and distances: each node with one of another root whose ball shares a variant with its own: the first in an order drawn by ``seed``."""
    order = np.lexsort((nodes, roots, fps))
    order = order[np.concatenate(([True], (fps[order][1:] != fps[order][:-1]) | (roots[order][1:] != roots[order][:-1])))]
    order = order[np.argsort(_again(nodes[order].astype(np.uint64), seed), kind="stable")]
    fps, nodes, roots = fps[order], nodes[order], roots[order]
    none = len(fps)
    best = np.full(none, none)
    for who, first, size in _meetings(fps, prefix, bits, radius, width):
        one = np.repeat(np.minimum.reduceat(who, first), size)
        other = np.where(roots[who] == roots[one], none, who)
        two = np.repeat(np.minimum.reduceat(other, first), size)
        np.minimum.at(best, who, np.where(roots[who] == roots[one], two, one))
    found = np.flatnonzero(best < none)
    return nodes[found], nodes[best[found]], np.bitwise_count(fps[found] ^ fps[best[found]]).astype(np.int64)


def _parts(fps: np.ndarray, entry: np.ndarray, width: int, bits: int, spread: np.ndarray) -> pa.RecordBatch:
    """(part, body): the entry of each fingerprint of each row, once for each leading part that its variants have."""
    table = np.tile(np.arange(fps.shape[1], dtype=np.uint64), len(fps))
    part = ((table << np.uint64(bits))[:, None] | ((fps.ravel() >> np.uint64(width - bits))[:, None] ^ spread[None, :])).ravel()
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    bodies = [entry[x // len(spread)].tobytes() for x in np.split(order, first[1:])]
    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int64)), pa.array(bodies, pa.binary())], names=["part", "body"])


def _met(rows: DataFrame, many: int, width: int, tables: int, radius: int, seed: int | None = None) -> DataFrame:
    """(t, a, b, d): per table t whom each node meets, at distance d; -1 where all that it meets are listed, and for a crowded node with itself."""
    if radius % 2:
        raise ValueError("radius must be even")
    half = radius // 2
    ball = sum(comb(width, i) for i in range(half + 1))
    bits = min(24, max(2, (many * ball // PART_TABLE_VARIANTS).bit_length()))
    spread = _masks(bits, half)
    node_bytes = max(1, -(-max(1, many).bit_length() // 8))
    sizes = [-(-width // 8), node_bytes, *([node_bytes] if seed is not None else [])]
    ends = np.cumsum(sizes).tolist()

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            fps = np.array(batch.column(0).to_pylist(), np.int64).view("<u8")
            numbers = [np.repeat(c.to_numpy().astype("<u8"), tables) for c in batch.columns[1:]]
            entry = np.concatenate([x.view(np.uint8).reshape(-1, 8)[:, :k] for x, k in zip([fps.ravel(), *numbers], sizes, strict=True)], axis=1)
            yield _parts(fps, entry, width, bits, spread)

    def done(part: int, bodies: list[bytes]) -> pa.RecordBatch:
        entry = np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, ends[-1])
        wide = np.zeros((len(sizes), len(entry), 8), np.uint8)
        for k, (size, end) in enumerate(zip(sizes, ends, strict=True)):
            wide[k, :, :size] = entry[:, end - size : end]
        fps, *numbers = wide.view("<u8")[:, :, 0]
        numbers, prefix = [x.astype(np.int64) for x in numbers], part & ((1 << bits) - 1)
        if seed is None:
            places = _distinct(fps, *numbers)
            rest = [list(_meetings(places[0], prefix, bits, radius, width)), prefix, bits, width]
            x, y, crowd = _uncrowded(*places, *rest)
            a, b, d = _central(*places, *rest)
            # the others have all theirs listed
            held = np.isin(a, crowd)
            a, b, d = np.concatenate([a[held], x, crowd]), np.concatenate([b[held], y, crowd]), np.concatenate([d[held], np.full(len(x) + len(crowd), -1)])
        else:
            a, b, d = across(fps, *numbers, seed * tables + (part >> bits) + 1, prefix, bits, radius, width)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), part >> bits, np.int32)), pa.array(a), pa.array(b), pa.array(d.astype(np.int32))], names=["t", "a", "b", "d"])

    columns = ["fps", "node", *(["root"] if seed is not None else [])]
    dealt = rows.select(*columns).mapInArrow(deal, "part long, body binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(lambda stream: _by_key(stream, done), "t int, a long, b long, d int")


def _in_tables(met: DataFrame) -> DataFrame:
    """(a, b, n) with a > b: the pairs of ``_met``, of those with a distance the closest of a node in a table, and in how many tables."""
    closest = met.where("d >= 0").groupBy("a", "t").agg(F.min(F.struct("d", "b")).alias("c")).select("a", F.col("c.b").alias("b"), "t")
    pairs = closest.union(met.where("d < 0 AND a <> b").select("a", "b", "t"))
    return pairs.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.bit_count(F.bit_or(F.expr("shiftleft(1L, t)"))).alias("n"))


def candidates(rows: DataFrame, many: int, width: int, tables: int, radius: int, seed: int | None = None) -> DataFrame:
    """(a, b, n) with a > b: whom each node of ``rows`` (node, fps) meets, of crowded nodes the most central, and in how many tables.

    With a ``seed`` the rows have a root as well, and a node is given partners of other roots, in an order drawn anew for
    each table. ``many`` bounds nodes and roots, which count from 0. A fingerprint goes once to each leading part that
    its variants have, in as many bytes as it and its node need. A crowded node has one partner in a part at most, and the
    closest of them in a table, so links grow with the rows and not with the squares of groups; what it meets besides are
    crowded ones, and ``_crossing`` has those pairs.
    """
    return _in_tables(_met(rows, many, width, tables, radius, seed))


#: Crowded nodes of a block. Pairs of two blocks are verified together, so that a set is sent once for all of these.
BLOCK = 128
#: Variants of one table that a part of ``_crossing`` holds, about, and pairs that it holds at a time.
CROWD_VARIANTS, PAIRS = 32_000_000, 50_000
#: Pairs from which on a part of ``_crossing`` tells what it has found so far.
TOLD = 1_000_000


def _most_apart(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Of how many bits two sets of these sizes may differ in to be verified."""
    return np.where(np.minimum(x, y) < FEW, int(MOST_APART_FEW * bits), int(MOST_APART * bits))


def crossing(fps: np.ndarray, roots: np.ndarray, sizes: np.ndarray, table: int, prefix: int, bits: int, radius: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places x < y of ``fps`` (a row of all tables each): all that meet first in this table, have different roots and may be alike.

    Those who share a variant are ordered by their root, so that only pairs of different roots are gone through. A pair may
    be told of more than once.
    """
    order = np.argsort(roots, kind="stable")
    fps, roots, sizes = fps[order], roots[order], sizes[order]
    new = np.flatnonzero(np.concatenate(([True], roots[1:] != roots[:-1])))
    # _meetings keeps no order within a variant
    for who, first, size in _meetings(np.ascontiguousarray(fps[:, table]), prefix, bits, radius, width):
        group = np.repeat(np.arange(len(first)), size)
        who = who[np.lexsort((who, group))]
        run = new[np.searchsorted(new, who, "right") - 1]
        start = first[group]
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (run[1:] != run[:-1])))
        before = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] - start
        ends = np.cumsum(before)
        lo = 0
        while lo < len(who):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            n = before[lo:hi]
            mine = np.repeat(np.arange(lo, hi), n)
            other = start[mine] + np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)
            pairs = np.unique(who[mine] * len(fps) + who[other])
            x, y = pairs // len(fps), pairs % len(fps)
            small, large = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
            near = small * SHARE[1] >= large * SHARE[0]
            x, y = x[near], y[near]
            apart = np.bitwise_count(fps[x] ^ fps[y])
            good = (apart.sum(axis=1, dtype=np.int64) <= _most_apart(sizes[x], sizes[y], width * fps.shape[1])) & ~(apart[:, :table] <= radius).any(axis=1)
            x, y = order[x[good]], order[y[good]]
            if len(x):
                yield np.minimum(x, y), np.maximum(x, y)
            lo = hi


def _crossing(rows: DataFrame, many: int, nodes: int, width: int, tables: int, radius: int) -> DataFrame:
    """(cell, body): a row for each two blocks that have some, all pairs of ``crossing`` among ``rows`` (fps, place, root, size).

    ``many`` bounds the places and ``nodes`` the roots. A cell's body has each end's number within its block in a byte.
    """
    half = radius // 2
    ball = sum(comb(width, i) for i in range(half + 1))
    bits = min(24, max(2, (many * ball // CROWD_VARIANTS).bit_length()))
    spread = _masks(bits, half)
    wide, narrow = -(-width // 8), [max(1, -(-max(1, x).bit_length() // 8)) for x in (many, nodes)] + [5]
    ends = (tables * wide + np.cumsum([0, *narrow])).tolist()

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in stream for part in few_rows(whole)):
            fps = np.array(batch.column(0).to_pylist(), np.int64).view("<u8")
            body = fps.view(np.uint8).reshape(len(fps), tables, 8)[:, :, :wide].reshape(len(fps), -1)
            numbers = [c.to_numpy().astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k] for c, k in zip(batch.columns[1:], narrow, strict=True)]
            yield _parts(fps, np.repeat(np.concatenate([body, *numbers], axis=1), tables, axis=0), width, bits, spread)

    def done(part: int, bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        entry = np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, ends[-1])
        fps = np.zeros((len(entry), tables, 8), np.uint8)
        fps[:, :, :wide] = entry[:, : ends[0]].reshape(-1, tables, wide)
        numbers = np.zeros((3, len(entry), 8), np.uint8)
        for k, size in enumerate(narrow):
            numbers[k, :, :size] = entry[:, ends[k] : ends[k + 1]]
        place, root, size = numbers.view("<u8")[:, :, 0].astype(np.int64)
        found, new = np.zeros(0, np.int64), []
        for x, y in crossing(fps.view("<u8")[:, :, 0], root, size, part >> bits, part & ((1 << bits) - 1), bits, radius, width):
            new.append(np.minimum(place[x], place[y]) << 32 | np.maximum(place[x], place[y]))
            if sum(map(len, new)) > TOLD:
                found, new = np.unique(np.concatenate([found, *new])), []
                if len(found) > TOLD:
                    yield told(found)
                    found = found[:0]
        if len(found) or new:
            yield told(np.unique(np.concatenate([found, *new])))

    def told(found: np.ndarray) -> pa.RecordBatch:
        x, y = found >> 32, found & 0xFFFFFFFF
        cell = x // BLOCK << 32 | y // BLOCK
        order = np.argsort(cell, kind="stable")
        cell, inner = cell[order], np.stack([x[order] % BLOCK, y[order] % BLOCK], axis=1).astype(np.uint8)
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(cell[first]), pa.array([x.tobytes() for x in np.split(inner, first[1:])], pa.binary())], names=["cell", "body"])

    def merged(cell: int, bodies: list[bytes]) -> pa.RecordBatch:
        inner = np.unique(np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, 2), axis=0)
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([inner.tobytes()], pa.binary())], names=["cell", "body"])

    dealt = rows.select("fps", "place", "root", "size").mapInArrow(deal, "part long, body binary").repartition("part").sortWithinPartitions("part")
    found = dealt.mapInArrow(lambda stream: (batch for found in _by_key(stream, done) for batch in found), "cell long, body binary")
    return found.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda stream: _by_key(stream, merged), "cell long, body binary")


def _ends(cell: int, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places that a cell has."""
    inner = np.frombuffer(body, np.uint8).reshape(-1, 2).astype(np.int64)
    return (cell >> 32) * BLOCK + inner[:, 0], (cell & 0xFFFFFFFF) * BLOCK + inner[:, 1]


def _cell_places(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, place) for the places that the bodies of cells have."""
    for batch in stream:
        if batch.num_rows:
            found = [(cell, np.unique(np.concatenate(_ends(cell, body)))) for cell, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            cells = np.repeat([cell for cell, _ in found], [len(place) for _, place in found])
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(np.concatenate([place for _, place in found]))], names=["cell", "place"])


def _verified_cells(cells: DataFrame, wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between nodes for the pairs of ``cells`` that are alike; a cell is sent those of ``sets`` (place, node, body) that are ``wanted`` in it."""

    def linked(cell: int, pairs: bytes, known: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        number = {place: k for k, place in enumerate(known)}
        union, out = _Union(len(known)), []
        for x, y in zip(*(e.tolist() for e in _ends(cell, pairs)), strict=True):
            if union.find(number[x]) != union.find(number[y]) and alike(known[x][1], known[y][1]):
                union.join(number[x], number[y])
                out.append((known[x][0], known[y][0]))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs, known = None, b"", {}
        for batch in (part for whole in stream for part in few_rows(whole)):
            for cell, place, node, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != now:
                    if pairs:
                        yield linked(now, pairs, known)
                    now, pairs, known = cell, b"", {}
                if place < 0:
                    pairs = body
                else:
                    known[place] = node, np.frombuffer(body, np.uint64)
        if pairs:
            yield linked(now, pairs, known)

    both = wanted.join(sets, "place").select("cell", "place", "node", "body").union(cells.select("cell", F.lit(-1).cast("long"), F.lit(-1).cast("long"), "body"))
    return both.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def _numbered(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``rows``, which are at rest, numbered from 0 by partition; and how many there are. One number a partition reaches the driver."""
    marked = cut(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in marked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for k, n in sizes:
        starts.append((k, total))
        total += n
    known = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _start long"))
    number = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return marked.join(known, part == F.col("_part")).withColumn(name, number).drop("_at", "_part", "_start"), total


def _verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are alike on all their shingles; ``texts`` has (node, text)."""
    x, y = (texts.select(F.col("node").alias(k), F.col("text").alias(t)) for k, t in (("a", "x"), ("b", "y")))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in stream:
            out = []
            for part in few_rows(batch):
                for mine, other in zip(blobs(part.column(2)), blobs(part.column(3)), strict=True):
                    if other != last:
                        last, known = other, shingle_set(other, words)
                    out.append(alike(shingle_set(mine, words), known))
            good = batch.filter(pa.array(out, pa.bool_()))
            yield pa.RecordBatch.from_arrays([good.column(0), good.column(1)], names=["a", "b"])

    # many pairs may have one b: that join comes last, so that it is split where it is skewed
    return meet(pairs.select("a", "b").join(x, "a"), y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _similar(rows: DataFrame, words: int, width: int, tables: int, radius: int) -> DataFrame:
    """(doc_id, digest, component_id, kept) of ``rows`` (doc_id, text): kept is the row with the least (doc_id, digest) of each component."""
    keyed = rows.select("doc_id", F.sha2("text", 256).alias("digest"), "text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in stream for part in few_rows(whole)):
            sets = [shingle_set(x, words) for x in blobs(batch.column(2))]
            names = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            fps = pa.array([table_fingerprints(x, width, tables).view(np.int64) for x in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names, fps, sizes], names=["doc_id", "digest", "set", "fps", "size"])

    marked = cut(keyed.mapInArrow(run, "doc_id long, digest string, set binary, fps array<long>, size long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    # equal sets are one node
    classes, many = _numbered(marked.groupBy("set").agg(first, F.first("fps").alias("fps"), F.first("size").alias("size")), "node")
    end = lambda k, x: classes.select(F.col("node").alias(k), F.col("fps").alias(x), F.col("size").alias(f"size_{x}"))
    most = F.when(F.least("size_x", "size_y") < FEW, int(MOST_APART_FEW * width * tables)).otherwise(int(MOST_APART * width * tables))
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)

    def likely(pairs: DataFrame) -> DataFrame:
        """Chance pairs agree in the bits of one table only, and are told by those of all."""
        sized = F.least("size_x", "size_y") * SHARE[1] >= F.greatest("size_x", "size_y") * SHARE[0]
        return cut(pairs.join(end("a", "x"), "a").join(end("b", "y"), "b").where(sized & (apart <= most)).select("a", "b", "n"))

    def fetched(nodes: DataFrame) -> DataFrame:
        """(node, text): the text of each set that is asked for is fetched once, from any of the rows that have it."""
        wanted = cut(nodes.distinct().join(classes.select("node", F.col("first.digest").alias("digest")), "node"))
        few = F.broadcast(wanted) if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else wanted
        return keyed.select("digest", "text").join(few, "digest").groupBy("node").agg(F.first("text").alias("text"))

    def verified(pairs: DataFrame) -> DataFrame:
        return cut(_verified(pairs, fetched(pairs.select(F.explode(F.array("a", "b")).alias("node"))), words))

    def crossed(crowd: DataFrame, root: DataFrame) -> DataFrame:
        """(a, b): all links among crowded nodes of different roots; those around one text are neighbours in place and share blocks."""
        both = pairs.select("a", "b", "n").union(pairs.select("b", "a", "n"))
        hub = both.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("hub"))
        held = classes.select("node", "fps", "size").join(crowd, "node").join(root, "node", "left").join(hub, "node", "left")
        ordered = held.select("node", "fps", "size", F.coalesce("root", "node").alias("root"), F.coalesce(-F.col("hub.b"), "node").alias("hub")).orderBy("hub", "node")
        placed, total = _numbered(cut(ordered), "place")
        placed = cut(placed)
        cells = cut(_crossing(placed, total, many, width, tables, radius))
        wanted = cells.mapInArrow(_cell_places, "cell long, place long")
        asked = wanted.select("place").distinct().join(placed.select("place", "node"), "place")
        sets = fetched(asked.select("node")).mapInArrow(hashed, "node long, body binary").join(asked, "node")
        return cut(_verified_cells(cells, wanted, sets))

    def hashed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in stream for part in few_rows(whole)):
            sets = [shingle_set(x, words).tobytes() for x in blobs(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "body"])

    def parted(pairs: DataFrame, root: DataFrame) -> DataFrame:
        """Those of the pairs whose ends have different roots."""
        at = lambda k: root.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
        both = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")
        return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")

    def steps(edges: DataFrame) -> DataFrame:
        """(node, root): where two steps down from a node lead, each to its least neighbour; equal roots are surely connected."""
        down = edges.groupBy("a").agg(F.min("b").alias("b"))
        next_down = down.select(F.col("a").alias("b"), F.col("b").alias("c"))
        return cut(down.join(next_down, "b", "left").select(F.col("a").alias("node"), F.coalesce("c", "b").alias("root")))

    met = cut(_met(classes, many, width, tables, radius))
    pairs = likely(_in_tables(met))
    crowd = cut(met.where("a = b").select(F.col("a").alias("node")).distinct())
    # each node's most frequent candidate first; the others only where that leaves two roots
    best = cut(pairs.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("most")).select("a", (-F.col("most.b")).alias("b")))
    edges = verified(best)
    rest = cut(parted(pairs.join(best, ["a", "b"], "left_anti"), steps(edges)))
    if not rest.isEmpty():
        edges = cut(edges.union(verified(rest)))
    # a crowded node's partner may hide others that are alike: all pairs of crowded nodes whose roots still differ
    if not crowd.isEmpty():
        edges = cut(edges.union(crossed(crowd, steps(edges))))
    root = connected_components(edges)
    rooted = classes.select("set", "first", "node").join(root, "node", "left").select("set", "first", F.coalesce("root", "node").alias("root"))
    named = meet(rooted, rooted.groupBy("root").agg(F.min("first").alias("least")), "root").select("set", "least")
    found = marked.select("doc_id", "digest", "set").join(cut(named), "set")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("digest") == F.col("least.digest"))
    return found.select("doc_id", "digest", F.col("least.doc_id").alias("component_id"), kept.alias("kept"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def similar_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, width: int = WIDTH, tables: int = TABLES, radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id (smallest doc_id reachable over similar pairs).

    Texts are linked if their sets of word shingles have a Jaccard similarity of four fifths or more and one of
    ``tables`` fingerprints of ``width`` bits is within ``radius`` bits; no others are. Null, empty and wordless texts are
    linked with each other, and so are texts of fewer words than a shingle that have the same words. Rows that repeat an
    id are judged each by its text; a null id names a component only if nothing else is in it. Extra columns are
    ignored. No rows give no rows.
    """
    return _similar(_rows(docs, id_col, text_col), words, width, tables, radius).select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, width: int = WIDTH, tables: int = TABLES, radius: int = 4) -> DataFrame:
    """Of each component of ``similar_copies`` the row with the smallest doc_id, with all its columns.

    A null id comes last; of rows that share the smallest id, the one whose text has the least SHA-256 stays. Rows
    that repeat both are one document and stay together.
    """
    found = _similar(_rows(docs, id_col, text_col), words, width, tables, radius)
    gone = cut(found.where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct())
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.sha2(text, 256) == F.col("_digest")), "left_anti")
