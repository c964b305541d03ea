"""Removal of long repeated byte strings by a depth-limited radix sort of suffixes.

Sorting every suffix through ``length`` bytes would move every byte ``length`` times. Two facts keep it to the
suffixes that can repeat at all:

* Each window of ``length`` bytes names one of its inner runs of ``INNER`` bytes, the one of least hash, as its
  anchor. The choice depends on the window's bytes alone, so equal windows have equal anchors at equal places.
* An anchor whose bytes stand nowhere else belongs to no repeated window.

So anchors (about one for each fifty bytes) are compared by hash first. Around those that occur again, the windows
they stand for are dealt out by anchor and ordered most significant digit first: the first digit is (anchor, place
in the window), then come eight bytes at a time down to the depth limit. A group that a digit leaves whole is not
sorted again; a window that is alone drops out. Groups left at the depth limit are exactly the repeated windows.

Copies within a map task meet there: one of them stands for all in the shuffle, so a passage that a third of all
documents share reaches a reducer once per task.

An anchor inside a line that very many documents have, each in other surroundings, would put all its windows on one
reducer. Anchors are counted where they are compared, and the windows of such a one are dealt out by what they cover beside it:
a few places in the window at a time, by the bytes that all windows with these places have.

A document is known by a 128-bit digest of its id and its text. Rows equal in both have equal results; of those in one
task, all but the first are settled on the spot, for each is a copy of the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs

#: Bytes of an anchor; documents and bytes per group of the joins; windows that a reducer orders at a time.
INNER, GROUP_DOCS, GROUP_BYTES, CHUNK = 100, 256, 4 << 20, 400_000
#: Bytes of text whose anchors and windows meet in one reducer, which holds up to five times as many at once; anchors
#: that a map task gathers before it sends them on.
ROUTE_BYTES, TASK_ANCHORS = 32 << 20, 1_000_000
#: Occurrences from which an anchor's windows are dealt out by their places, and how many places go together.
HOT, PLACES = 8_000, 10

_rng = np.random.default_rng(7)
_LETTERS = _rng.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        tables = []
        for x in (_BASE, inverse):
            t = np.full(size, x, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[size] = tuple(tables)
    return _powers[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` bytes."""
    up, down = _power_tables(len(b) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[b] * up[: len(b)], dtype=np.uint64)))
    return _mixed((total[k:] - total[:-k]) * down[: len(b) - k + 1])


def anchors(texts: list[bytes], length: int, inner: int) -> tuple[np.ndarray, ...]:
    """Anchors of the windows of each text: text number, first and last window start, anchor position, hash."""
    able = [i for i, t in enumerate(texts) if len(t) >= length]
    none = np.zeros(0, np.int64)
    if not able:
        return none, none, none, none, none.astype(np.uint64)
    sizes = np.array([len(texts[i]) for i in able])
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    b = np.frombuffer(b"".join(texts[i] for i in able), np.uint8)
    h = run_hashes(b, inner)
    span = length - inner + 1
    bits = np.uint64(max(1, len(h).bit_length()))
    # least hash first, then leftmost: the position rides in the low bits
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(key) // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, span)
    fore = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(b) - length + 1
    chosen = (np.minimum(back[:windows], fore[span - 1 : span - 1 + windows]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(able)), sizes)[:windows]
    inside = np.arange(windows) <= (first + sizes - length)[doc]
    change = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])))
    starts = np.flatnonzero(change)
    ends = np.concatenate((starts[1:], [windows])) - 1
    starts, ends = starts[inside[starts]], ends[inside[starts]]
    d = doc[starts]
    ends = np.minimum(ends, (first + sizes - length)[d])
    at = chosen[starts]
    return np.array(able)[d], starts - first[d], ends - first[d], at - first[d], h[at]


_CAND = (("k0", "<u8"), ("k1", "<u8"), ("start", "<i4"), ("n", "<u1"), ("lead", "<u1"), ("h", "<u8"))
_REGION = (*_CAND, ("again", "<u1"))
_HELD = (("h", "<u8"), ("g", "<i8"), ("many", "<u4"))
_SPAN = (("k0", "<u8"), ("k1", "<u8"), ("start", "<i4"), ("end", "<i4"))


def _write(columns: dict[str, np.ndarray], kind: tuple, tail: bytes = b"") -> bytes:
    n = len(columns[kind[0][0]])
    return b"".join([np.int64(n).tobytes(), *(np.ascontiguousarray(columns[k], t).tobytes() for k, t in kind), tail])


def _read(body: bytes, kind: tuple) -> tuple[dict[str, np.ndarray], int]:
    n, at, out = int(np.frombuffer(body, "<i8", 1)[0]), 8, {}
    for k, t in kind:
        out[k] = np.frombuffer(body, t, n, at)
        at += n * np.dtype(t).itemsize
    return out, at


def _joined(bodies: list[bytes], kind: tuple) -> dict[str, np.ndarray]:
    parts = [_read(x, kind)[0] for x in bodies]
    return {k: np.concatenate([p[k] for p in parts] or [np.zeros(0, t)]) for k, t in kind}


def _packed(columns: dict[str, np.ndarray]) -> list[bytes]:
    """The key of each row as bytes."""
    both = np.stack([columns["k0"], columns["k1"]], 1).astype("<u8")
    return [x.tobytes() for x in both]


def _take(columns: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[at] for k, v in columns.items()}


def _dealt(columns: dict[str, np.ndarray], kind: tuple, to: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows split by the number in ``to``, each part as one body."""
    order = np.argsort(to, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], to[order][1:] != to[order][:-1]))) if len(to) else np.zeros(0, np.int64)
    for part in np.split(order, edges[1:]) if len(to) else []:
        yield int(to[part[0]]), _write(_take(columns, part), kind)


def _groups(columns: dict[str, np.ndarray], groups: int) -> np.ndarray:
    """The join group of each row's document."""
    return (columns["k0"] % np.uint64(groups)).astype(np.int64)


def keys(ids: list[int | None], texts: list[bytes]) -> np.ndarray:
    """The two halves of each document's key, a row each."""
    made = (hashlib.blake2b(t, digest_size=16, key=b"" if i is None else str(i).encode()).digest() for i, t in zip(ids, texts, strict=True))
    return np.frombuffer(b"".join(made), "<u8").reshape(-1, 2)


def _repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur again, and which rows are the first of their value."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    count = np.diff(np.concatenate((np.flatnonzero(new), [len(s)])))
    again, first = np.zeros(len(s), bool), np.zeros(len(s), bool)
    again[order] = np.repeat(count > 1, count)
    first[order] = new
    return again, first


def radix_groups(buffer: np.ndarray, address: np.ndarray, digit: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at ``address`` are equal to another one, through ``length`` bytes.

    ``digit`` is the first digit; a window of weight 2 stands for copies and is never alone. ``buffer`` has eight
    spare bytes at its end.
    """
    words = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))
    out = np.zeros(len(address), bool)

    def regroup(order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Drop what is alone; number the groups that are left."""
        starts = np.flatnonzero(new)
        count = np.diff(np.concatenate((starts, [len(order)])))
        held = np.add.reduceat(weight[order], starts) if len(starts) else count
        good = np.repeat(held > 1, count)
        group = np.repeat(np.arange(len(starts)), count)
        return order[good], group[good]

    if not len(address):
        return out
    order = np.argsort(digit, kind="stable")
    order, group = regroup(order, np.concatenate(([True], digit[order][1:] != digit[order][:-1])))
    for depth in range(0, length, 8):
        if not len(order):
            break
        # the last digit reaches back over bytes that are equal already
        word = words[address[order] + min(depth, length - 8)]
        same = group[1:] == group[:-1]
        split = same & (word[1:] != word[:-1])
        if not split.any():
            continue
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][split]] = True
        sort = np.flatnonzero(mixed[group])
        by = np.lexsort((word[sort], group[sort]))
        order[sort], word[sort] = order[sort][by], word[sort][by]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])))
        order, group = regroup(order, new)
    out[order] = True
    return out


def _spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start, start + 1, ..., n of them, for each row; and the row of each."""
    row = np.repeat(np.arange(len(n)), n)
    return start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), row


def _by_places(columns: dict[str, np.ndarray], hot: np.ndarray, bodies: list[bytes], length: int, inner: int) -> tuple[dict[str, np.ndarray], list[bytes]]:
    """Anchors ``hot`` cut into runs of ``PLACES`` places, each under a hash of the bytes that all its windows cover.

    ``bodies`` has the document of each row. An anchor that stands p bytes after a window's start does so in all equal
    windows, so they fall into one run, and they have its bytes.
    """
    out: list[tuple] = []
    texts: list[bytes] = []
    for i in np.flatnonzero(hot).tolist():
        start, n, lead = int(columns["start"][i]), int(columns["n"][i]), int(columns["lead"][i])
        at = start + lead
        for low in range(0, length - inner + 1, PLACES):
            high = low + PLACES - 1
            first, last = max(low, lead - n + 1), min(high, lead)
            if first <= last:
                held = bodies[i][max(0, at - low) : at - high + length]
                name = hashlib.blake2b(held, digest_size=8, salt=low.to_bytes(4, "little")).digest()
                out.append((columns["k0"][i], columns["k1"][i], at - last, last - first + 1, last, int.from_bytes(name, "little")))
                texts.append(bodies[i])
    rest = np.flatnonzero(~hot)
    made = {k: np.array([x[j] for x in out], t) for j, (k, t) in enumerate(_CAND)}
    return {k: np.concatenate([columns[k][rest], made[k]]) for k, _ in _CAND}, [bodies[i] for i in rest.tolist()] + texts


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"route": pa.int32(), "kind": pa.int32(), "g": pa.int64(), "body": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names=list(names))


def repeated_spans(docs: DataFrame, length: int = 200, inner: int = INNER, group_docs: int = GROUP_DOCS, route_bytes: int = ROUTE_BYTES, task_anchors: int = TASK_ANCHORS, chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept, spans.

    ``kept`` is what is left of the bytes, ``spans`` the removed runs as (start, end).
    """
    if not 8 <= inner <= length - 7 or length - inner > 254:
        raise ValueError("inner must leave 7 to 254 bytes of the window")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    routes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), seen["size"] // route_bytes)
    groups = max(1, seen["n"] // group_docs, seen["size"] // GROUP_BYTES)

    def mark(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors of a task's documents; those repeated among them are settled, one of each asks the others."""
        held, many = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            c = {k: np.concatenate([x[k] for x in held]) for k, _ in _CAND}
            again, first = _repeated(c["h"])
            known = _take(c, np.flatnonzero(again))
            out = [(g % routes, 1, g, x) for g, x in _dealt(known, _CAND, _groups(known, groups))]
            # how often each of them stands in each group; one that nearly all groups have is named once for all
            if len(known["h"]):
                pair, many = np.unique(np.stack([known["h"], _groups(known, groups).astype(np.uint64)], 1), axis=0, return_counts=True)
                names, at = np.unique(pair[:, 0], return_inverse=True)
                total = np.bincount(at, many, len(names))
                wide = total[at] >= hot
                held_by = {"h": np.concatenate([pair[~wide, 0], names[total >= hot]]), "g": np.concatenate([pair[~wide, 1].astype(np.int64), np.full((total >= hot).sum(), -1)]), "many": np.concatenate([many[~wide], total[total >= hot]])}
                out += [(r, 2, 0, x) for r, x in _dealt(held_by, _HELD, (held_by["h"] % np.uint64(routes)).astype(np.int64))]
            ask = _take(c, np.flatnonzero(first)) | {"again": again[first].astype(np.uint8)}
            out += [(r, 0, 0, x) for r, x in _dealt(ask, _REGION, (ask["h"] % np.uint64(routes)).astype(np.int64))]
            for i in range(0, len(out), 256):
                yield _batch(out[i : i + 256], ("route", "kind", "g", "body"))

        for batch in stream:
            body = blobs(batch.column(1))
            key = keys(batch.column(0).to_pylist(), body)
            size, part = 0, []
            for i in range(len(body) + 1):
                if part and (i == len(body) or size + len(body[i]) > 1 << 20):
                    doc, a, b, at, h = anchors([body[j] for j in part], length, inner)
                    j = np.array(part)[doc]
                    held.append({"k0": key[j, 0], "k1": key[j, 1], "start": a.astype(np.int32), "n": (b - a + 1).astype(np.uint8), "lead": (at - a).astype(np.uint8), "h": h})
                    many += len(h)
                    size, part = 0, []
                    if many > task_anchors:
                        yield from sent()
                        held, many = [], 0
                if i < len(body):
                    part.append(i)
                    size += len(body[i])
        if many:
            yield from sent()

    def settle(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors that more than one task has; what was settled before passes through. Groups learn of the hot ones they have."""
        asked, counted = [], []
        for batch in stream:
            rows = []
            for kind, g, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if kind == 1:
                    rows.append((0, g, body))
                else:
                    (asked if kind == 0 else counted).append(body)
            if rows:
                yield _batch(rows, ("kind", "g", "body"))
        c = _joined(asked, _REGION)
        if not len(c["h"]):
            return
        held = _joined(counted, _HELD)
        again, _ = _repeated(c["h"])
        c = _take(c, np.flatnonzero(again & (c["again"] == 0)))
        alone = {"h": c["h"], "g": _groups(c, groups), "many": np.ones(len(c["h"]), np.uint32)}
        held = {k: np.concatenate([held[k], alone[k]]) for k, _ in _HELD}
        names, at = np.unique(held["h"], return_inverse=True)
        many = np.bincount(at, held["many"], len(names))
        rows = [(0, g, x) for g, x in _dealt(c, _CAND, _groups(c, groups))]
        told = _take(held, np.flatnonzero(many[at] >= hot)) if len(names) else held
        for h in np.unique(told["h"]).tolist():
            where = told["g"][told["h"] == h]
            rows += [(1, g, np.uint64(h).tobytes()) for g in (range(groups) if (where < 0).any() else np.unique(where).tolist())]
        for i in range(0, len(rows), 256):
            yield _batch(rows[i : i + 256], ("kind", "g", "body"))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        """Windows around the anchors of a group's documents, copies within the group settled."""
        rows = []
        if left.num_rows and right.num_rows:
            kinds, bodies = right.column("kind").to_pylist(), right.column("body").to_pylist()
            c = _joined([x for k, x in zip(kinds, bodies, strict=True) if not k], _CAND)
            wide = np.frombuffer(b"".join(x for k, x in zip(kinds, bodies, strict=True) if k), np.uint64)
            where = {k: i for i, k in enumerate(left.column("key").to_pylist())}
            bodies = blobs(left.column("text").combine_chunks())
            held = [bodies[where[k]] for k in _packed(c)]
            if len(wide):
                c, held = _by_places(c, np.isin(c["h"], wide), held, length, inner)
            parts = [x[s : s + n + length - 1] for x, s, n in zip(held, c["start"].tolist(), c["n"].tolist(), strict=True)]
            first: dict[tuple, int] = {}
            lone = np.zeros(len(parts), np.int64)
            for i, key in enumerate(zip(parts, c["lead"].tolist(), strict=True)):
                lone[i] = first.setdefault(key, i)
            count = np.bincount(lone, minlength=len(parts))
            again = count[lone] > 1
            done = _take(c, np.flatnonzero(again))
            if len(done["h"]):
                spans = {"k0": done["k0"], "k1": done["k1"], "start": done["start"], "end": done["start"] + done["n"] + (length - 1)}
                rows += [(g % routes, 1, g, x) for g, x in _dealt(spans, _SPAN, _groups(spans, groups))]
            ask = np.flatnonzero(lone == np.arange(len(parts)))
            to = (c["h"][ask] % np.uint64(routes)).astype(np.int64)
            for r in np.unique(to):
                at = ask[to == r]
                rows.append((int(r), 0, 0, _write(_take(c, at) | {"again": again[at].astype(np.uint8)}, _REGION, b"".join(parts[i] for i in at))))
        table = pa.Table.from_batches([_batch(rows, ("route", "kind", "g", "body"))]) if rows else None
        return table if table is not None else pa.table({"route": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "g": pa.array([], pa.int64()), "body": pa.array([], pa.binary())})

    def order(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Order the windows of a route's anchors; spans of repeated ones, and those settled before."""
        heads, texts = [], []
        for batch in stream:
            rows = []
            for kind, g, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if kind:
                    rows.append((g, body))
                else:
                    c, at = _read(body, _REGION)
                    heads.append(c)
                    texts.append(body[at:])
            if rows:
                yield _batch(rows, ("g", "body"))
        if not heads:
            return
        c = {k: np.concatenate([x[k] for x in heads]) for k, _ in _REGION}
        buffer = np.frombuffer(b"".join([*texts, bytes(8)]), np.uint8)
        del heads, texts
        size = c["n"].astype(np.int64) + length - 1
        base = np.cumsum(size) - size
        by = np.argsort(c["h"], kind="stable")
        h = c["h"][by]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        anchor = np.cumsum(new) - 1
        windows = np.cumsum(c["n"][by].astype(np.int64))
        ends = np.concatenate((np.flatnonzero(new)[1:], [len(by)]))

        def found(rows_at: np.ndarray, digit: np.ndarray, low: int, high: int) -> Iterator[pa.RecordBatch]:
            """Spans of the repeated windows in which the anchor stands ``low`` to ``high`` bytes after the start."""
            lead, n = c["lead"][rows_at].astype(np.int64), c["n"][rows_at].astype(np.int64)
            skip = np.maximum(0, lead - high)
            address, row = _spread(base[rows_at] + skip, np.maximum(0, np.minimum(n, lead - low + 1) - skip))
            offset = address - base[rows_at][row]
            again = c["again"][rows_at][row]
            hit = np.flatnonzero(radix_groups(buffer, address, digit[row] * 512 + lead[row] - offset, 1 + again.astype(np.int64), length) & (again == 0))
            if not len(hit):
                return
            start = c["start"][rows_at][row[hit]] + offset[hit]
            lows = np.flatnonzero(np.concatenate(([True], (row[hit][1:] != row[hit][:-1]) | (start[1:] != start[:-1] + 1))))
            highs = np.concatenate((lows[1:], [len(hit)])) - 1
            r = rows_at[row[hit][lows]]
            spans = {"k0": c["k0"][r], "k1": c["k1"][r], "start": start[lows].astype(np.int32), "end": (start[highs] + length).astype(np.int32)}
            out = list(_dealt(spans, _SPAN, _groups(spans, groups)))
            for i in range(0, len(out), 256):
                yield _batch(out[i : i + 256], ("g", "body"))

        at = 0
        while at < len(by):
            limit = (windows[at - 1] if at else 0) + chunk
            # whole anchors up to the limit; one beyond it by itself, some places at a time, since windows differ in them
            end = int(ends[max(np.searchsorted(windows[ends - 1], limit, "right") - 1, np.searchsorted(ends, at, "right"))])
            wide = windows[end - 1] - (windows[at - 1] if at else 0) > chunk
            step = max(1, chunk // (end - at)) if wide else 256
            for low in range(0, length - inner + 1, step):
                yield from found(by[at:end], anchor[at:end], low, low + step - 1)
            at = end

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        """Merge the spans of each document and leave out what they cover."""
        by: dict[bytes, list[tuple[int, int]]] = {}
        if right.num_rows:
            c = _joined(right.column("body").to_pylist(), _SPAN)
            for k, s, e in zip(_packed(c), c["start"].tolist(), c["end"].tolist(), strict=True):
                by.setdefault(k, []).append((s, e))
        ids, sizes, removed, many, kept, spans = [], [], [], [], [], []
        for doc_id, key, copy, body in zip(left.column("doc_id").to_pylist(), left.column("key").to_pylist(), left.column("copy").to_pylist(), blobs(left.column("text").combine_chunks()) if left.num_rows else [], strict=True):
            merged: list[list[int]] = []
            for s, e in ([(0, len(body))] if len(body) >= length else []) if copy else sorted(by.get(key, [])):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            edges = [0, *(x for m in merged for x in m), len(body)]
            ids.append(doc_id)
            sizes.append(len(body))
            removed.append(sum(e - s for s, e in merged))
            many.append(len(merged))
            kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            spans.append([{"start": s, "end": e} for s, e in merged])
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(many, pa.int64()),
            "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })

    def add_group(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Group and key of each row; a copy of an earlier row of the task, id and all, goes to any group."""
        times: dict[bytes, int] = {}
        for batch in stream:
            key = keys(batch.column(0).to_pylist(), blobs(batch.column(1)))
            packed = [x.tobytes() for x in key]
            nth = []
            for k in packed:
                nth.append(times.get(k, 0))
                times[k] = nth[-1] + 1
            nth = np.array(nth, np.uint64)
            g = ((key[:, 0] + _mixed(nth)) % np.uint64(groups)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(g), batch.column(0), pa.array(packed, pa.binary()), pa.array(nth > 0), batch.column(1)], names=["g", "doc_id", "key", "copy", "text"])

    grouped = rows.mapInArrow(add_group, "g long, doc_id long, key binary, copy boolean, text string")
    # the same exchange of texts serves both joins
    sides = grouped.groupBy("g")
    marked = rows.mapInArrow(mark, "route int, kind int, g long, body binary")
    known = marked.repartitionById(routes, "route").mapInArrow(settle, "kind int, g long, body binary")
    cuts = sides.cogroup(known.groupBy("g")).applyInArrow(cut, "route int, kind int, g long, body binary")
    spans = cuts.repartitionById(routes, "route").mapInArrow(order, "g long, body binary")
    return sides.cogroup(spans.groupBy("g")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>")


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept, spans.

    Every byte that a string of ``length`` bytes covers which starts anywhere else too, in the same document or in
    another, is removed; judged on the input. Null text counts as empty; texts shorter than ``length`` keep all.
    Rows that repeat an id, or have none, are documents of their own, and if they repeat the text too they are copies of
    each other. Other columns are ignored. No rows give no rows. A document must fit in a task.
    """
    return repeated_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), length, **options)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
