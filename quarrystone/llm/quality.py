"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import Trees, fit_boosted

#: Most labelled rows the model is fitted on: the labelled ids of smallest hash.
TRAIN_ROWS = 20_000
#: Bytes of text whose statistics are taken at once: some 60 times that is a worker's working memory.
SLICE_BYTES = 500_000
FEATURES = [
    "chars", "words", "word_length", "lower", "upper", "digits", "white", "lines", "stops", "commas", "bangs", "pipes",
    "marks", "other_ascii", "non_ascii", "distinct_words", "repeated_next", "top_word", "distinct_lines", "line_length",
    "upper_words",
]
#: Byte classes, in the order of FEATURES from "lower" to "non_ascii".
_CLASSES = np.full(256, 10, np.uint8)
_CLASSES[ord("a") : ord("z") + 1] = 0
_CLASSES[ord("A") : ord("Z") + 1] = 1
_CLASSES[ord("0") : ord("9") + 1] = 2
_CLASSES[[9, 11, 12, 13, 32]] = 3
_CLASSES[10] = 4
_CLASSES[ord(".")] = 5
_CLASSES[ord(",")] = 6
_CLASSES[[ord("!"), ord("?")]] = 7
_CLASSES[ord("|")] = 8
_CLASSES[[ord(c) for c in "#$%&*"]] = 9
_CLASSES[128:] = 11


def _within(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def _repeats(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each list: length, distinct values, values equal to the one before, count of the commonest value."""
    n = len(lists)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(bounds)
    owner = np.repeat(np.arange(n), lengths)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    keys, counts = np.unique(owner * (codes.max(initial=0) + 1) + codes, return_counts=True)
    of = keys // (codes.max(initial=0) + 1)
    top = np.zeros(n)
    np.maximum.at(top, of, counts)
    return lengths.astype(float), np.bincount(of, minlength=n).astype(float), _within(same, bounds), top


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text.  Null counts as empty; an empty text gives zeros."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    bounds = offsets - offsets[0]
    size = np.diff(bounds).astype(float)
    kind = _CLASSES[data]
    share = [_within(kind == c, bounds) / np.maximum(size, 1) for c in range(12)]
    words, distinct, again, top = _repeats(pc.utf8_split_whitespace(texts))
    lines, distinct_lines, _, _ = _repeats(pc.split_pattern(texts, "\n"))
    words[size == 0] = lines[size == 0] = 0
    ends = np.zeros(len(kind), bool)  # an upper-case letter after another
    ends[1:] = (kind[1:] == 1) & (kind[:-1] == 1)
    w = np.maximum(words, 1)
    out = [
        np.log1p(size), np.log1p(words), size / w, *share, distinct / w, again / w, top / w, distinct_lines / np.maximum(lines, 1),
        size / np.maximum(lines, 1), _within(ends, bounds) / np.maximum(size, 1),
    ]
    return np.stack(out, axis=1) * (size > 0)[:, None]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text, one row at least: bounds memory whatever the texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                x = statistics(batch.column(1))
                features = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), features], ["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, x array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``most`` labelled documents that are not held out (crc32 of the id as text, mod 3, is 1).

    Labels of one id that contradict each other, null labels and null ids are left out.  The ids are few by that
    bound, so they are broadcast and only their texts are read on.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_hi")).where("y = _hi")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "y")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    # of several texts under one id the one of smallest statistics counts, whatever the order of the rows
    stats = document_statistics(texts, "doc_id", "text").groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = stats.join(F.broadcast(known), "doc_id").orderBy("doc_id").limit(most).toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_boosted(x, np.array(rows["y"].to_pylist(), float))


def score_quality(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """``extra`` columns, doc_id, held_out, score and predicted for every row, scored by its text alone.

    Null and empty texts have all statistics zero and get the score of such a text; a text of any length counts
    whole.  Repeated rows get equal scores.  A null id is not held out.  No rows give no rows.  ``extra`` columns with
    the name of a result are left out; the result takes their place.
    """
    others = [c for c in extra if c not in (id_col, text_col, "doc_id", "held_out", "score", "predicted")]
    picked = docs.select(*[F.col(c).alias(f"_{c}") for c in others], F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    at = len(others) + 1
    kept = at + (text_col in extra)  # the text goes back only if it is wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                score = pa.array(model.probability(statistics(batch.column(at))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], score], [*batch.schema.names[:kept], "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:kept])
    out = picked.mapInArrow(run, f"{schema}, score double")
    return out.select(
        *[F.col(f"_{c}").alias(c) for c in others],
        *([F.col("text").alias(text_col)] if kept > at else []),
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
