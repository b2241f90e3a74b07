"""Harmonic packing of tokenised documents into fixed sequences."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, ranked, release_memory, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SLICE_BYTES = 2_000_000
#: Distinct chunks whose ids a task remembers.
CACHE_CHUNKS = 400_000
#: The shape of tokenizer that allows the chunk vocabulary (fixed values of the tokenizer file).
WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_SPLIT = {
    "type": "Split",
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Letters that NFC leaves alone and whose lower case is one letter; each word of them is one piece.
PLAIN = re.compile("[a-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Plain words that are encoded as one text.
RUN = 256


class WordTokens:
    """Token ids of texts as the unmodified tokenizer gives them (``add_special_tokens=False``).

    A tokenizer of the WORD_NORMALIZER and WORD_SPLIT shape lower-cases, drops white space and never joins a letter
    or digit with the punctuation after it, so a text's ids are the ids of its white-space-separated chunks in order;
    A-Z is lowered and ASCII punctuation set apart after a-z0-9 and Latin-1 letters beforehand to make chunks recur.
    Each distinct chunk is encoded once; the rest is numpy gathering.  Chunks of plain letters alone, nearly all, need
    the byte step and the model only: many are encoded as one text, and the end-of-word ids tell where each ends.
    Texts for which that does not hold are encoded whole: those with the
    string of an added token, those with a combining mark after A-Z (its lower case may compose where the upper case
    does not), and all texts where the tokenizer has another shape.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        shape = json.loads(self.tok.to_str())
        normalizers = (shape.get("normalizer") or {}).get("normalizers")
        splits = (shape.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        self.chunked = normalizers == WORD_NORMALIZER and splits[0] == WORD_SPLIT
        odd = ["[A-Z]\\p{M}"] + ["(?i)" + re.escape(t["content"]) for t in shape.get("added_tokens") or []]
        self.whole = "|".join(odd)
        self.words, suffix = None, shape["model"].get("end_of_word_suffix")
        if self.chunked and splits[1:] == [BYTE_LEVEL] and suffix:
            self.words = Tokenizer(self.tok.model)
            bytes_ = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_])
            vocab = shape["model"]["vocab"]
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.empty(0, np.uint32)
        self.offs = np.empty(0, np.int64)
        self.lens = np.empty(0, np.int64)

    def _encoded(self, texts: list[str], tok=None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text, one after another, and how many each has."""
        got = [e.ids for e in (tok or self.tok).encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(lens.sum())), lens

    def _encoded_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encoded``, for plain words."""
        ids, _ = self._encoded([" ".join(words[i : i + RUN]).lower() for i in range(0, len(words), RUN)], self.words)
        lens = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        return (ids, lens) if len(lens) == len(words) else self._encoded(words)  # a vocabulary without some letters

    def _ids(self, uniques: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_CHUNKS:
            self.reset()
        known = self.known
        new = [u for u in uniques if u not in known]
        if new:
            plain: list[str] = []
            odd: list[str] = []
            for u in new:
                (plain if self.words and PLAIN(u) else odd).append(u)
            new = plain + odd
            ids, lens = map(np.concatenate, zip(self._encoded_words(plain), self._encoded(odd)))
            at = len(self.pool) + np.cumsum(lens) - lens
            known.update(zip(new, range(len(self.lens), len(self.lens) + len(new))))
            self.pool = np.concatenate([self.pool, ids])
            self.offs, self.lens = np.concatenate([self.offs, at]), np.concatenate([self.lens, lens])
        return np.fromiter(map(known.__getitem__, uniques), np.int64, len(uniques))

    def _by_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), pattern="([a-z0-9À-ÖØ-öø-ÿ])([!-/:-@\\[-`{-~])", replacement="\\1 \\2")
        lists = pc.ascii_split_whitespace(plain)
        coded = lists.flatten().dictionary_encode()
        vid = self._ids(coded.dictionary.to_pylist())
        v = vid[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
        lens = self.lens[v]
        ends = np.concatenate([[0], np.cumsum(lens)])
        offsets = lists.offsets.to_numpy().astype(np.int64)
        ids = self.pool[np.repeat(self.offs[v] - ends[:-1], lens) + np.arange(ends[-1])]
        return ids, ends[offsets - offsets[0]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text in them."""
        if not self.chunked:
            ids, lens = self._encoded(texts.to_pylist())
            return ids, np.concatenate([[0], np.cumsum(lens)])
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False))
        if not len(odd):
            return self._by_chunks(texts)
        rest = np.setdiff1d(np.arange(len(texts)), odd)
        ids, bounds = self._by_chunks(texts.take(pa.array(rest)))
        ids_odd, lens_odd = self._encoded(texts.take(pa.array(odd)).to_pylist())
        parts: list[np.ndarray] = [ids[:0]] * len(texts)
        for i, a, b in zip(rest.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            parts[i] = ids[a:b]
        for i, part in zip(odd.tolist(), np.split(ids_odd, np.cumsum(lens_odd)[:-1])):
            parts[i] = part
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def piece_sizes(capacity: int, least: int) -> list[int]:
    """The sizes a document may be cut to: capacity // k down to ``least``."""
    return sorted({capacity // k for k in range(1, capacity // least + 1)}, reverse=True)


def cut(n: int, sizes: list[int]) -> list[int]:
    """Lengths of a document's pieces: the largest class size that fits, again and again; a short rest stays."""
    out = [sizes[0]] * (n // sizes[0])
    n %= sizes[0]
    for s in sizes[1:]:
        while n >= s:
            out.append(s)
            n -= s
    return out + [n] if n else out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, least: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    sizes = piece_sizes(capacity, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tok = WordTokens(tokenizer)  # of this task alone: nothing stays in the worker
        try:
            cuts: dict[int, list[int]] = {}
            for batch in batches:
                texts = pc.fill_null(batch.column(1), "")
                sizes_b = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
                i = 0
                while i < len(texts):
                    j = max(i + 1, int(np.searchsorted(sizes_b, sizes_b[i] + SLICE_BYTES, "right")) - 1)
                    ids, bounds = tok.encode(pa.concat_arrays([texts.slice(i, j - i)]))
                    rows: list[tuple] = []
                    for doc, a, b in zip(batch.column(0).slice(i, j - i).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                        own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                        n, at = len(own), 0
                        pieces = cuts.get(n)
                        if pieces is None:
                            pieces = cuts[n] = cut(n, sizes)
                        for size in pieces:
                            rows.append((doc, at, size, zlib.crc32(own[at : at + size]), n))
                            at += size
                    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
                    i = j
        finally:
            del tok
            release_memory()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def pack_rest(rest: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """First-fit decreasing of the few pieces that fill no whole bin: (length, ordinal, bin, offset)."""
    room: list[int] = []
    out = []
    for size in sorted(rest, reverse=True):
        at = 0
        for j in range(rest[size]):
            while at < len(room) and room[at] < size:
                at += 1
            if at == len(room):
                room.append(capacity)
            out.append((size, j, at, capacity - room[at]))
            room[at] -= size
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, least: int = 64, end_id: int = 1, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is cut into pieces of the reciprocal sizes capacity // k (k up to capacity // least) and a rest
    below ``least``, so each piece belongs to a class whose bins hold exactly capacity // length documents.
    Piece i of a class goes to bin i // that count: workers fill their classes without talking to each other,
    knowing only how many pieces came before theirs.  The pieces that fill no whole bin, at most one bin's worth
    for each class (a bound the capacity sets, whatever the input), are packed together first-fit decreasing.

    Ids are those of the unmodified ``tokenizer`` file with add_special_tokens=False: the string of an added token in
    a text gives that token's id.  Any tokenizer file will do; only one of the word shape is encoded by chunks.

    A null or empty text is its end token alone; a text of any length is encoded whole.  Repeated rows (also of equal ids) are packed each; a null id
    stays null.  Other columns are ignored.  No rows give no rows.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, least, end_id, id_col, text_col), "pieces")
    classes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = docs.sparkSession
    base, first, rest = 0, [], {}
    for size in sorted(classes, reverse=True):
        per = capacity // size
        full = classes[size] // per
        first.append((size, per, base, full * per))
        base += full
        if classes[size] % per:
            rest[size] = classes[size] % per
    tail = [(size, j, base + at, off) for size, j, at, off in pack_rest(rest, capacity)]
    table = F.broadcast(spark.createDataFrame(first, "length long, per long, base long, whole long"))
    ends = F.broadcast(spark.createDataFrame(tail, "length long, ordinal long, tail_id long, tail_offset long"))
    buckets = bucket_count(sum(classes.values()))
    order = [F.col("doc_id"), F.col("start"), F.col("ids_crc32"), F.col("doc_tokens")]
    out = ranked(pieces, ["length"], F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"), order, "i")
    out = out.join(table, "length").withColumn("ordinal", F.when(F.col("i") >= F.col("whole"), F.col("i") - F.col("whole")))
    out = out.join(ends, ["length", "ordinal"], "left")
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("tail_id", F.expr("base + i div per")).alias("sequence_id"),
        F.coalesce("tail_offset", F.expr("(i % per) * length")).alias("offset"),
    )
