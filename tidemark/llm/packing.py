"""Sequence packing by minimum bin slack.

Documents become token pieces of at most one window; full windows stand alone. The rest are dealt into buckets
of a fixed size by a hash, and each bucket fills windows one after another: the longest remaining piece is set,
and a subset-sum table over the multiset of remaining lengths, kept as one bitset per step, tells which sums
the others can reach. The fullest one is traced back to counts per length.

A sequence whose length is a power of two needs no padding. So each bucket is filled a second time with such lengths
preferred to a fuller window that isn't full, and that plan is taken only where it pads less in all.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Pieces a bucket holds on average, about: enough different lengths to fill windows, few enough for one task.
BUCKET_DOCS = 20_000

_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
_COUNTED = pa.schema([*_PIECE, ("nth", pa.int64())])
_PACKED = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])

#: Fixed value: the pre-tokenizer of byte-level BPE, with possessive quantifiers where backing off can't match.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_encoders: dict[str, object] = {}


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """A function from text to ids for a byte-level BPE file in the format of ``tokenizers``; one for each process.

    The merges run in tiktoken, which is several times as fast and gives the same ids (tests compare them). A text is
    cut at the strings of the file's added tokens first, and each of them is its own id, as in ``tokenizers``.
    """
    if path not in _encoders:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = _byte_letters()
        special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        ordinary = tiktoken.Encoding("byte-bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

        def encode(text: str) -> list[int]:
            if cut is None or not cut.search(text):
                return ordinary(text)
            parts = cut.split(text)
            return [i for k, part in enumerate(parts) for i in ([special[part]] if k % 2 else ordinary(part))]

        _encoders[path] = encode
    return _encoders[path]


def best_fill(lengths: list[int], counts: dict[int, int], room: int, aims: list[int]) -> list[int]:
    """Lengths (with repeats) whose sum is ``room``, or the first of ``aims`` that some sum reaches, or the largest sum below.

    ``lengths`` are in descending order. Each length enters the bitset in parts of 1, 2, 4, ... pieces, so the
    trace back gives counts within what is there.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        left = min(counts[length], room // length)
        part = 1
        while left > 0:
            part = min(part, left)
            steps.append((reach, length, part))
            reach |= (reach << (length * part)) & full
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    total = room if reach >> room & 1 else next((x for x in aims if reach >> x & 1), reach.bit_length() - 1)
    taken = []
    for before, length, part in reversed(steps):
        if not before >> total & 1:
            taken += [length] * part
            total -= length * part
    return taken


def padding(loads: list[int], window: int) -> int:
    """Tokens added to sequences of these lengths: none at a power of two, else up to ``window``."""
    return sum(0 if n & (n - 1) == 0 else window - n for n in loads)


def minimum_bin_slack(sizes: list[int], window: int) -> list[list[int]]:
    """Windows as lists of positions in ``sizes`` (each 1 to ``window``), every position in exactly one.

    The longest remaining piece opens a window, and the sum closest to its capacity is taken. A plan that takes a
    sum ending at a power of two before a fuller one stands instead if it needs less padding.
    """
    plans = [_filled(sizes, window, aim) for aim in (False, True)]
    return min(plans, key=lambda bins: padding([sum(sizes[i] for i in b) for b in bins], window))


def _filled(sizes: list[int], window: int, aim: bool) -> list[list[int]]:
    """One plan; with ``aim`` a power of two comes before any sum but the full one."""
    stock: dict[int, list[int]] = defaultdict(list)
    for i in range(len(sizes) - 1, -1, -1):
        stock[sizes[i]].append(i)
    counts = {k: len(v) for k, v in stock.items()}
    order = sorted(counts, reverse=True)
    powers = [1 << k for k in range(window.bit_length() - 1, 6, -1)] if aim else []
    out = []
    while order:
        first = order[0]
        counts[first] -= 1
        room = window - first
        able = [x for x in order if x <= room and counts[x]]
        pick = [first]
        if room and able:
            pick += best_fill(able, counts, room, [p - first for p in powers if first <= p < window])
        for x in pick[1:]:
            counts[x] -= 1
        times = 1 + min(((counts[x] // pick.count(x)) for x in set(pick)), default=0) if sum(pick) == window else 1
        for x in pick:
            counts[x] -= times - 1
        out += [[stock[x].pop() for x in pick] for _ in range(times)]
        if not all(counts[x] for x in set(pick)):
            order = [x for x in order if counts[x]]
    return out


def pieces(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, nth) for each run of at most ``window`` tokens of each document.

    ``nth`` counts the rows before it in the task that are equal in all else, so that equal rows can be told apart.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        times: Counter[int] = Counter()
        for batch in stream:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = np.array([*encode(text), end_id], "<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    row = (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids))
                    rows.append((*row, times[hash(row)]))
                    times[hash(row)] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _COUNTED, strict=True)], schema=_COUNTED)

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return wanted.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long")


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty and has the end token alone. Sequences number from 0 within each bucket, with the
    bucket in the high bits; offsets leave no gap. Rows that repeat an id are pieces of their own. Other columns
    are ignored. No rows give no rows. Buckets are about one for each ``bucket_docs`` documents or windows of text.
    """
    text = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0))
    # four bytes make a token, about
    many = docs.agg(F.count("*") + F.coalesce(F.sum(text), F.lit(0)) / (4 * window)).first()[0]
    buckets = max(1, round(many / bucket_docs))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(bucket: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts)
            size = rows.column("length").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            whole = np.flatnonzero(size == window)
            sequence[whole] = np.arange(len(whole))
            rest = np.flatnonzero(size < window)
            for k, members in enumerate(minimum_bin_slack(size[rest].tolist(), window), len(whole)):
                at = 0
                for i in members:
                    sequence[rest[i]], offset[rest[i]] = k, at
                    at += int(size[rest[i]])
            sequence += bucket << 40
            yield from pa.Table.from_arrays([*rows.columns[1:-1], pa.array(sequence), pa.array(offset)], schema=_PACKED).combine_chunks().to_batches(20_000)

        now, parts = None, []
        for batch in stream:
            key = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b == a:
                    continue
                if key[a] != now:
                    if parts:
                        yield from done(now, parts)
                    now, parts = int(key[a]), []
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from done(now, parts)

    cut_up = pieces(docs, tokenizer, window, end_id, id_col, text_col)
    keyed = cut_up.select(F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32", "nth"), F.lit(buckets)).alias("bucket"), "*")
    dealt = keyed.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "start", "ids_crc32")
    return dealt.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
