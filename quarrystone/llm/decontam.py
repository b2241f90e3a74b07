"""Benchmark decontamination by winnowing.

Each document keeps the minimum k-gram hash of every run of w k-grams; so does each benchmark item.  With
k + w - 1 = window, two texts that share ``window`` consecutive words always share a kept hash, so joining the
fingerprints loses no contaminated document.  In a document with a hit, the windows around the positions of its hits
(w starts for each) are extended on the words themselves and held against the benchmark's windows.
Native DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .urlfilter import lower_ascii

#: Everything that is not a word character, as in the word pattern [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in either case: enough to count words.
NOT_WORD_OR_UPPER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Benchmarks of at most this many (window, item) rows and bytes of words are broadcast; larger ones are shuffled.
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Documents with a hit, or items found in them, whose keys are broadcast (40 bytes each); more are joined by shuffle.
BROADCAST_DOCUMENTS = 250_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def grams(hashes: str, n: int) -> Column:
    """Hashes of the n-grams of an array of word hashes, one per start."""
    parts = ", ".join(["x", *(f"get({hashes}, i + {j})" for j in range(1, n))])
    return F.expr(f"slice(transform({hashes}, (x, i) -> xxhash64({n}, {parts})), 1, greatest(size({hashes}) - {n - 1}, 0))")


def winnowed(gram_hashes: str, w: int) -> Column:
    """Distinct minima of every run of w gram hashes (of all of them where they are fewer)."""
    parts = ", ".join(f"get({gram_hashes}, i + {j})" for j in range(1, w))
    runs = f"greatest(size({gram_hashes}) - {w - 1}, least(size({gram_hashes}), 1))"
    return F.expr(f"array_distinct(slice(transform({gram_hashes}, (x, i) -> least(x, {parts})), 1, {runs}))")


def _fingerprints(df: DataFrame, k: int, w: int, short: list[int]) -> Column:
    keep = winnowed("g", w)
    if not short:
        return keep
    return F.array_distinct(F.concat(keep, *[grams("wh", n) for n in short]))


def benchmark_windows(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct (words, length, item_id) windows: ``window`` consecutive words, or all words of a shorter item."""
    w = items.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("ws"))
    w = w.where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))
    w = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, window))).alias("win"))
    return w.select("item_id", F.array_join("win", " ").alias("words"), F.size("win").alias("length")).distinct()


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """All rows of ``docs`` plus n_words, n_hit, n_items, items (sorted item ids as strings) and contaminated.

    A document word inside any occurrence of a benchmark window is hit.  Null and empty texts have no words and
    are never contaminated; items without words match nothing; repeated documents and items each count as they
    are (an item repeated under one id counts once); a null item id occurs as no item but its words are hit.  An
    empty benchmark or document table hits nothing.  Texts of any length are read whole.  Input columns with the
    names of the results are replaced.

    Rows are known by the hashes of id and text, so copies of a text under their own ids are spread; rows equal in
    both meet only in plain joins, which Spark can split, and in sums.  Every broadcast side is counted first.
    """
    made = ("n_words", "n_hit", "n_items", "items", "contaminated")
    docs = docs.drop(*made)
    wins = written(benchmark_windows(items, window, item_col, item_text_col), "windows")
    sizes = {r["length"]: (r["n"], r["b"]) for r in wins.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("words")).alias("b")).collect()}
    few = sum(n for n, _ in sizes.values()) <= BROADCAST_WINDOWS and sum(b for _, b in sizes.values()) <= BROADCAST_BYTES
    sent = F.broadcast if few else (lambda x: x)
    short = sorted(n for n in sizes if n < window)
    w = window - k + 1

    def hashed(df: DataFrame, text: Column) -> DataFrame:
        df = df.withColumn("ws", words(text)).withColumn("wh", F.transform("ws", lambda x: F.xxhash64(x)))
        return df.withColumn("g", grams("wh", k))

    own = F.when(F.col("length") == window, winnowed("g", w))
    for n in short:
        own = own.when(F.col("length") == n, grams("wh", n))
    item_fps = hashed(wins.select("words", "length").distinct(), F.col("words")).select("length", F.explode(own).alias("fp")).distinct()

    text = F.col(text_col)
    key = [
        F.xxhash64(id_col).alias("__k0"), F.xxhash64(text_col).alias("__k1"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("__k2"), F.length(text).alias("__k3"),
    ]
    keys = ["__k0", "__k1", "__k2", "__k3"]
    fps = hashed(docs.where(F.length(text_col) > 0), text).select(*key, F.explode(_fingerprints(docs, k, w, short)).alias("fp"))
    candidates = written(fps.join(sent(item_fps.select("fp").distinct()), "fp", "left_semi").select(*keys).distinct(), "candidates")

    def by_key(left: DataFrame, right: DataFrame, rows: int, how: str) -> DataFrame:
        return left.join(F.broadcast(right) if rows <= BROADCAST_DOCUMENTS else right, keys, how)

    texts = docs.where(F.length(text_col) > 0).select(*key, text.alias("t"))
    placed = hashed(by_key(texts, candidates, candidates.count(), "left_semi"), F.col("t"))
    placed = written(placed.select(*keys, "ws", "wh", "g"), "hit-texts")
    families = [(window, "g", k)] * (window in sizes) + [(n, "own", n) for n in short]
    spans = None
    for length, column, n in families:
        at = placed if column == "g" else placed.withColumn("own", grams("wh", n))
        at = at.select(*keys, F.lit(length).alias("length"), F.posexplode(column).alias("at", "fp"))
        spans = at if spans is None else spans.unionByName(at)
    base = docs.select("*", *key, F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD_OR_UPPER, -1), "")).cast("long").alias("n_words"))
    if spans is None:
        empty = F.array().cast("array<string>")
        return base.drop(*keys).withColumns({"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items": empty, "contaminated": F.lit(False)})
    spans = spans.join(sent(item_fps), ["length", "fp"], "left_semi")
    # a hit of a gram at p lies in the windows that start at p - (w - 1) to p; a short item's gram is its window
    first = F.when(F.col("length") == window, F.greatest(F.col("at") - (w - 1), F.lit(0))).otherwise(F.col("at"))
    starts = spans.select(*keys, "length", F.explode(F.sequence(first, F.col("at"))).alias("pos")).distinct()
    starts = starts.groupBy(*keys).agg(F.collect_list(F.struct("length", "pos")).alias("starts"))
    around = placed.select(*keys, "ws").join(starts, keys).select(*keys, "ws", F.explode("starts").alias("s"))
    around = around.where(F.col("s.pos") + F.col("s.length") <= F.size("ws"))
    around = around.select(*keys, F.col("s.length").alias("length"), F.col("s.pos").alias("pos"), F.expr("array_join(slice(ws, s.pos + 1, s.length), ' ')").alias("words"))
    hits = written(around.join(sent(wins.select("words").distinct()), "words", "left_semi").distinct(), "hits")
    covered = hits.select(*keys, F.explode(F.sequence("pos", F.expr("pos + length - 1"))).alias("p")).distinct()
    n_hit = covered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hit"))
    found = hits.select(*keys, "words").distinct().join(sent(wins.select("words", F.col("item_id").cast("string").alias("item"))), "words")
    found = found.groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("items"))
    result = written(n_hit.join(found, keys, "left"), "found")
    dropped(candidates, placed, hits, wins)
    n = result.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    out = by_key(base, result, n, "left").drop(*keys)
    items_found = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.withColumns(
        {
            "n_hit": F.coalesce(F.col("n_hit"), F.lit(0).cast("long")),
            "items": items_found,
            "n_items": F.size(items_found).cast("long"),
            "contaminated": F.coalesce(F.col("n_hit"), F.lit(0)) > 0,
        }
    )
