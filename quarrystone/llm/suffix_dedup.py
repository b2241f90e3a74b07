"""Removal of long repeated strings by a distributed difference-cover algorithm.

The suffixes that matter are compared to a fixed depth K (200 bytes), so the recursion is cut at that depth and the
cover is wide: 8 residues modulo 57, the perfect difference set of that order, instead of 2 modulo 3.

1. Sampled tuples: suffixes whose start modulo 57 is in the cover get the name of their first K - 56 bytes.  Names are
   sorted; adjacent equal ones mark suffixes whose tuple is repeated.
2. Any two equal K-byte strings, whatever their starts, have a pair of sampled suffixes at one distance from their
   starts below 57 (the difference-cover property), and the tuples of that pair lie inside the strings.  So a start
   without a repeated sampled tuple among the next 57 is dropped.
3. Recursion and merge: the remaining suffixes, sampled or not, get the name of their K-byte prefix; names are sorted
   again, and at this depth the recursion ends.
4. Adjacent equal names are repeated strings; the bytes they cover are removed.

A name is a 64-bit fingerprint and names are sorted as numbers, not in alphabetical order: only equality and adjacency
count.  Work is done in blocks of whole documents.  A block sends each range of names its own sorted distinct names;
the range answers one bit for each, so a name held by a third of all documents comes once from each block.  The pass
that names the remaining suffixes leaves the last pass one bit for each sampled tuple, so tuples are named twice, not
three times.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import _TABLE, U, mix, power_tables, powers, text_bytes

MODULUS = 57
#: Eight residues whose differences are every residue modulo 57 (fixed values).
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
#: Bytes that are worked on at once (one longer text is a slice): their arrays stay in a core's own cache.
SLICE_BYTES = 100_000
#: Bits of a tuple's name beyond those that number the samples: chance repeats are one in 2**FILTER_BITS.
FILTER_BITS = 12
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 4 << 20, 64 << 20, 2048

#: Base and byte table of the second polynomial.
_P2 = 0xD6E8FEB86659FD93
_TABLE2 = mix(_TABLE ^ U(0xA5A5A5A5A5A5A5A5))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def polynomial(which: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte table and at least ``n`` powers up and down; those of a usual slice are kept, longer ones are not."""

    def made(n: int) -> tuple[np.ndarray, np.ndarray]:
        return (powers(_P2, n), powers(pow(_P2, -1, 1 << 64), n)) if which else power_tables(n)

    if which not in _POWERS:
        _POWERS[which] = made(2 * SLICE_BYTES)
    up, down = _POWERS[which] if n <= 2 * SLICE_BYTES else made(n)
    return _TABLE2 if which else _TABLE, up, down


class Slice:
    """Consecutive documents of a block: bytes, bounds and names of any substring length.

    A name mixes two polynomial fingerprints of different bases and byte tables: strings that agree in the low bits of
    one by their own likeness still differ in the name like any two random numbers.  The filter of sampled tuples, whose
    false repeats cost work alone, mixes one.
    """

    def __init__(self, texts: pa.Array) -> None:
        self.data, self.bounds = text_bytes(texts)
        n = len(self.data)
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def fingerprints(self, which: int, at: np.ndarray, length: int) -> np.ndarray:
        if which not in self.sums:
            n = len(self.data)
            table, up, down = polynomial(which, n + 1)
            total = np.zeros(n + 1, U)
            np.cumsum(table[self.data] * up[:n], out=total[1:])
            self.sums[which] = total, down
        total, down = self.sums[which]
        return (total[at + length] - total[at]) * down[at]

    def names(self, at: np.ndarray, length: int) -> np.ndarray:
        return mix(mix(self.fingerprints(0, at, length)) + self.fingerprints(1, at, length))

    def sampled(self, depth: int) -> np.ndarray:
        """Starts in the cover, counted from the document's start, with ``depth`` bytes left in the document."""
        out = []
        for r in COVER:
            first, last = self.bounds[:-1] + r, self.bounds[1:] - depth
            count = np.maximum((last - first) // MODULUS + 1, 0)
            count[last < first] = 0
            each = np.repeat(np.cumsum(count) - count, count)
            out.append(np.repeat(first, count) + (np.arange(count.sum()) - each) * MODULUS)
        return np.concatenate(out)

    def remaining(self, repeated: np.ndarray, depth: int) -> np.ndarray:
        """Starts with ``depth`` bytes left and a repeated sampled name among the next MODULUS starts."""
        mark = np.zeros(len(self.data) + 1, np.int32)
        mark[repeated + 1] = 1
        before = np.cumsum(mark, dtype=np.int32)
        n = len(self.data) - depth + 1
        if n <= 0:
            return np.empty(0, np.int64)
        ok = before[MODULUS : MODULUS + n] > before[:n]
        at = np.flatnonzero(ok)
        owner = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        return at[owner[at] == owner[at + depth - 1]]


def slices_of(table: pa.Table) -> list[tuple[int, int]]:
    texts = table["text"]
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())])
    out, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + SLICE_BYTES, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def parts(t: pa.Table) -> Iterator[tuple[int, Slice]]:
    """The slices of a block and the row at which each begins."""
    texts = t["text"].combine_chunks()
    for i, j in slices_of(t):
        yield i, Slice(texts.slice(i, j - i))


def ordered(t: pa.Table) -> pa.Table:
    """The block's documents in an order of their own: rows come from an exchange in any, also when a task runs again.

    Equal texts need no order among themselves: their sampled tuples are the same.
    """
    return t.take(pc.sort_indices(t, sort_keys=[("text", "ascending")])).combine_chunks()


def encoded(names: np.ndarray) -> bytes:
    """Sorted distinct names as byte planes of their differences, compressed."""
    steps = np.diff(names, prepend=U(0))
    return len(names).to_bytes(8, "little") + pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="lz4", asbytes=True)


def decoded(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = pa.decompress(blob[8:], decompressed_size=8 * n, codec="lz4", asbytes=True)
    return np.cumsum(np.frombuffer(planes, np.uint8).reshape(8, n).T.copy().view(U).ravel(), dtype=U)


def ranges(names: np.ndarray, count: int) -> np.ndarray:
    """Bounds of ``count`` equal ranges of 64-bit numbers in the sorted names."""
    edge = np.array([(i << 64) // count for i in range(1, count)], U)
    return np.concatenate([[0], np.searchsorted(names, edge, "left"), [len(names)]])


def messages(names: np.ndarray, block: int, count: int) -> pa.Table:
    at = ranges(names, count)
    full = np.flatnonzero(np.diff(at))
    return pa.table(
        {
            "bucket": pa.array(full, pa.int32()),
            "block": pa.array([block] * len(full), pa.int32()),
            "names": pa.array([encoded(names[at[i] : at[i + 1]]) for i in full], pa.binary()),
        }
    )


PACKED = "block int, docs binary"


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, doc_id, text) as compressed runs of one block each: what the exchange moves."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        block = batch.column(0).to_numpy()
        order = np.argsort(block, kind="stable")
        t = pa.Table.from_batches([batch]).select([1, 2]).take(pa.array(order)).combine_chunks()
        at = np.flatnonzero(np.diff(block[order], prepend=-1))
        out = []
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=options) as w:
                w.write_table(t.slice(a, b - a))
            out.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(block[order][at], pa.int32()), pa.array(out, pa.binary())], ["block", "docs"])


def unpacked(t: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in t["docs"].to_pylist()]).combine_chunks()


MESSAGE = "bucket int, block int, names binary"
ANSWER = "block int, level int, bucket int, bits binary"


def _answer(level: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:  # a block's note to itself
            return pa.table({"block": t["block"], "level": pa.array([0] * t.num_rows, pa.int32()), "bucket": t["bucket"], "bits": t["names"]})
        lists = [decoded(x) for x in t["names"].to_pylist()]
        names = np.concatenate(lists)
        order = np.argsort(names, kind="stable")
        sorted_ = names[order]
        same = sorted_[1:] == sorted_[:-1]
        hit = np.zeros(len(names), bool)  # adjacent equal names are names of more than one block
        hit[1:] |= same
        hit[:-1] |= same
        back = np.empty(len(names), bool)
        back[order] = hit
        ends = np.cumsum([len(x) for x in lists])
        bits = [np.packbits(x).tobytes() for x in np.split(back, ends[:-1])]
        n = t.num_rows
        return pa.table(
            {
                "block": t["block"], "level": pa.array([level] * n, pa.int32()), "bucket": t["bucket"],
                "bits": pa.array(bits, pa.binary()),
            }
        )

    return run


def heard(names: np.ndarray, count: int, answers: pa.Table, level: int) -> np.ndarray:
    """For each of the sorted distinct names: whether another block has it."""
    at = ranges(names, count)
    out = np.zeros(len(names), bool)
    for lv, bucket, bits in zip(*(answers[c].to_pylist() for c in ("level", "bucket", "bits"))):
        if lv == level:
            n = int(at[bucket + 1] - at[bucket])
            out[at[bucket] : at[bucket + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
    return out


class Job:
    """The three passes over a block.  They meet only in the order of sorted names, never in row order.

    Both later passes list a block's documents in one order, that of ``ordered``, so the second can tell the third which
    sampled tuples are repeated by one bit for each.
    """

    def __init__(self, depth: int, shift: int, buckets: int) -> None:
        self.depth, self.shift, self.buckets = depth, shift, buckets
        self.tuple = depth - MODULUS + 1

    def tuples(self, s: Slice) -> np.ndarray:
        names = mix(s.fingerprints(0, s.sampled(self.tuple), self.tuple))
        return (names >> U(self.shift)) << U(self.shift)  # a filter: fewer bits do

    def level0(self, t: pa.Table) -> np.ndarray:
        """Tuple names of the block's sampled suffixes."""
        return _joined([self.tuples(s) for _, s in parts(t)])

    def level1(self, t: pa.Table, many: np.ndarray):
        """For each slice its remaining starts and their names; ``many`` marks the repeated ones of all sampled tuples."""
        begin = 0
        for i, s in parts(t):
            at = s.sampled(self.tuple)
            left = s.remaining(at[many[begin : begin + len(at)]], self.depth)
            begin += len(at)
            yield i, s, left, s.names(left, self.depth)

    def names0(self, key, t: pa.Table) -> pa.Table:
        return messages(_distinct(self.level0(t)), key[0].as_py(), self.buckets)

    def names1(self, key, t: pa.Table, answers: pa.Table) -> pa.Table:
        block, t = key[0].as_py(), ordered(t)
        many = repeated(self.level0(t), self.buckets, answers, 0)
        names = _distinct(_joined([h for *_, h in self.level1(t, many)]))
        note = pa.array([np.packbits(many).tobytes()], pa.binary())
        own = pa.table({"bucket": pa.array([self.buckets + block], pa.int32()), "block": pa.array([block], pa.int32()), "names": note})
        return pa.concat_tables([messages(names, block, self.buckets), own])

    def removed(self, key, t: pa.Table, answers: pa.Table) -> pa.Table:
        t = ordered(t)
        note = answers.filter(pc.equal(answers["level"], 0))["bits"][0].as_py()
        found = [(i, len(s.bounds) - 1, left, h) for i, s, left, h in self.level1(t, np.unpackbits(np.frombuffer(note, np.uint8)).view(bool))]
        many = repeated(_joined([h for *_, h in found]), self.buckets, answers, 1)
        texts = t["text"].combine_chunks()
        begin = 0
        cols: list[list] = [[], [], [], [], []]
        for i, n, left, h in found:
            data, bounds = text_bytes(texts.slice(i, n))
            hit = left[many[begin : begin + len(h)]]
            begin += len(h)
            turn = np.zeros(len(data) + 1, np.int32)
            turn[hit] += 1
            turn[hit + self.depth] -= 1
            gone = np.cumsum(turn[:-1]) > 0
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            inner = bounds[:-1][bounds[:-1] < bounds[1:]]
            edge[inner] = gone[inner]
            sums = lambda x: np.concatenate([[0], np.cumsum(x)])[bounds]
            kept = data[~gone].tobytes()
            place = sums(~gone)
            cols[0] += t["doc_id"].slice(i, n).to_pylist()
            cols[1] += np.diff(bounds).tolist()
            cols[2] += np.diff(sums(gone)).tolist()
            cols[3] += np.diff(sums(edge)).tolist()
            cols[4] += [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(place[:-1].tolist(), place[1:].tolist())]
        kinds = [t.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.table({c: pa.array(v, k) for c, v, k in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), cols, kinds)})


def _joined(x: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.empty(0, U), *x])


def _distinct(names: np.ndarray) -> np.ndarray:
    """Sorted distinct names."""
    names = np.sort(names)
    return names[_first(names)]


def _first(sorted_: np.ndarray) -> np.ndarray:
    first = np.ones(len(sorted_), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=first[1:])
    return first


def repeated(names: np.ndarray, count: int, answers: pa.Table, level: int) -> np.ndarray:
    """For each of a block's names: whether it occurs again, in this block or another."""
    order = np.argsort(names)
    sorted_ = names[order]
    first = _first(sorted_)
    at = np.flatnonzero(first)
    many = np.diff(at, append=len(names)) > 1
    many |= heard(sorted_[at], count, answers, level)
    out = np.empty(len(names), bool)
    out[order] = many[np.cumsum(first) - 1]
    return out


def remove_repeats(docs: DataFrame, depth: int = 200, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    A byte is removed if a string of ``depth`` bytes that also starts anywhere else, same document included,
    covers it; strings never cross documents and are judged on the input.  Null counts as empty; texts shorter
    than ``depth`` are kept whole; repeated rows remove each other.  Other columns are ignored.  No rows give no
    rows.  The texts are shuffled once, compressed; all three passes read that one exchange.
    """
    if depth < MODULUS:
        raise ValueError(f"depth must be {MODULUS} at least")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    size = block_bytes or min(max(total // BLOCKS, LEAST_BLOCK), MOST_BLOCK)
    blocks = max(1, -(-total // size))
    samples = max(2, total * len(COVER) // MODULUS)
    job = Job(depth, max(0, 64 - math.ceil(math.log2(samples)) - FILTER_BITS), blocks)
    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int")
    rows = docs.select(block.alias("block"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.mapInArrow(packed, PACKED).groupBy("block")
    sent = dealt.applyInArrow(lambda key, t: job.names0(key, unpacked(t)), MESSAGE)
    answers = sent.groupBy("bucket").applyInArrow(_answer(0, blocks), ANSWER)
    sent = dealt.cogroup(answers.groupBy("block")).applyInArrow(lambda key, t, a: job.names1(key, unpacked(t), a), MESSAGE)
    answers = sent.groupBy("bucket").applyInArrow(_answer(1, blocks), ANSWER)
    return dealt.cogroup(answers.groupBy("block")).applyInArrow(
        lambda key, t, a: job.removed(key, unpacked(t), a), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
