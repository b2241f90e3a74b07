"""MinHash near-dedup with DartMinHash signatures, banded joining, exact verification and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .quality import slices

#: Nodes whose keys may be broadcast to fetch their shingles (40 bytes each); more are joined by shuffle.
BROADCAST_NODES = 250_000
#: Buckets up to this size are compared in full where they still hold several components.
SMALL_BUCKET = 32
#: Members that a shingle of exact rank in the rare-shingle join may have.
COMMON = 64
#: Links between components that one task may join.
BRIDGES = 100_000
#: Entries of one shingle that one task of the rare-shingle join holds against the others.
SHINGLE_BLOCK = 512
U = np.uint64
MASK = (1 << 64) - 1
#: Bytes of text that are hashed at once: some 60 times that is a worker's working memory (one longer text is a slice).
SIGN_BYTES = 500_000
_P, _PINV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_TABLE = mix(np.arange(1, 257, dtype=U))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the fingerprint base and of its inverse."""
    return powers(_P, n), powers(_PINV, n)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts (null: none), and each text's bounds in them."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def shingles(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every run of ``size`` words (white-space separated) of each text, and their owners.

    A text of fewer words has one shingle of all of them; a text without words has none.
    """
    data, bounds = text_bytes(texts)
    word = ~_SPACE[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    inner = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[inner] = word[inner]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = word
    ends[1:-1] &= ~(word[1:] & ~starts[1:])
    a, b = np.flatnonzero(starts), np.flatnonzero(ends)
    up, down = power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_TABLE[data] * up[:-1], out=total[1:])
    own = (total[b] - total[a]) * down[a]
    h = mix(own + (b - a).astype(U))
    owner = np.searchsorted(bounds, a, "right") - 1
    count = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    at = np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    who = np.repeat(np.arange(len(texts)), n)
    stop = np.minimum(first[who + 1], at + size)
    out = np.zeros(len(at), U)
    for j in range(size):
        i = at + j
        inside = i < stop
        out = mix(out + U(0x632BE59BD9B4E019 * (j + 1) & MASK) + np.where(inside, h[np.minimum(i, max(len(h) - 1, 0))] if len(h) else U(0), U(0)))
    return out, who


def poisson_cdf(rate: float) -> np.ndarray:
    """P(count <= i) for i = 0, 1, ... until it is 1 to double precision."""
    n = int(rate + 12 * np.sqrt(rate) + 24)
    terms = np.exp(-rate) * np.concatenate([[1.0], np.multiply.accumulate(rate / np.arange(1, n))])
    return np.minimum(np.cumsum(terms), 1.0)


def dart_signatures(elements: np.ndarray, owner: np.ndarray, n: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """DartMinHash signatures (n x k) of ``n`` weighted sets; all ones where a set is empty.

    Each element owns a region: weight axis times rank axis.  A hash of (element, cell, ordinal) throws darts of
    unit rate into the cells of that region; a dart counts where its weight coordinate is below the element's
    weight; it hits one of the k coordinates, and the earliest rank wins each.  Cells are visited in rank order
    until a set's coordinates are all hit: later darts have later ranks and change nothing.  That takes about
    k (ln k + 0.6) darts a set, whatever its size.  Equal elements throw equal darts, so repeats change nothing.
    """
    unit = weights is None
    weights = np.ones(len(elements)) if unit else weights
    best = np.full(n * k, np.inf)
    sig = np.full(n * k, MASK, U)
    live = np.bincount(owner, weights, n) > 0
    low, width, cell = 0.0, 0.25, 0
    layers = int(np.ceil(weights.max(initial=1.0)))
    while live.any():
        use = np.arange(len(elements)) if live.all() else np.flatnonzero(live[owner])
        cdf = poisson_cdf(width)
        for layer in range(layers):  # unit layers of the weight axis
            rows = use[weights[use] > layer] if layer else use
            seed = mix(elements[rows] + U((0xD1B54A32D192ED03 * (cell + 1) + 0x8CB92BA72F3D8DD7 * layer) & MASK))
            count = np.searchsorted(cdf, (seed >> U(11)).astype(float) / float(1 << 53), "right")
            some = np.flatnonzero(count)
            count = count[some]
            first = np.repeat(np.cumsum(count) - count, count)
            ordinal = (np.arange(len(first)) - first + 1).astype(U)
            some = np.repeat(some, count)
            dart = mix(seed[some] + ordinal * U(0xA0761D6478BD642F))
            rank = low + width * ((dart >> U(24)).astype(float) / float(1 << 40))
            hit = owner[rows[some]] * k + ((dart & U(0xFFFFFF)) * U(k) >> U(24)).astype(np.int64)
            good = rank < best[hit]
            if not unit:
                good &= layer + (mix(dart) >> U(11)).astype(float) / float(1 << 53) < weights[rows[some]]
            hit, rank, dart = hit[good], rank[good], dart[good]
            order = np.lexsort((rank, hit))
            hit, rank, dart = hit[order], rank[order], dart[order]
            lead = np.ones(len(hit), bool)
            lead[1:] = hit[1:] != hit[:-1]
            best[hit[lead]] = rank[lead]
            sig[hit[lead]] = dart[lead]
        low, cell = low + width, cell + 1
        width = min(max(width, low / 2), 64.0)
        live &= np.isinf(best.reshape(n, k)).any(axis=1)
    return sig.reshape(n, k)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    n, k = sig.shape
    rows = k // bands
    out = np.broadcast_to(np.arange(bands, dtype=U) * U(0x9E3779B97F4A7C15), (n, bands)).copy()
    for j in range(rows):
        out = mix(out + sig[:, j : rows * bands : rows])
    return out.view(np.int64)


def distinct_shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, their owners and how often each occurs in its text."""
    h, who = shingles(texts, size)
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    at = np.flatnonzero(new)
    return h[at], who[at], np.diff(np.append(at, len(h)))


def banded(docs: DataFrame, k: int, bands: int, size: int, kind: str, weighted: bool) -> DataFrame:
    """doc_id, tkey, the number of distinct shingles and the band keys of each row (doc_id, tkey, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, SIGN_BYTES):
                h, who, often = distinct_shingles(batch.column(2), size)
                n = np.bincount(who, minlength=batch.num_rows)
                keys = band_keys(dart_signatures(h, who, batch.num_rows, k, often.astype(float) if weighted else None), bands)
                lists = [x if c else [] for x, c in zip(keys.tolist(), n)]
                columns = [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(lists, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tkey", "n", "bands"])

    return docs.mapInArrow(run, f"doc_id {kind}, tkey string, n int, bands array<long>")


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(nid, sets): the distinct shingle hashes of each text (nid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SIGN_BYTES):
                h, who, _ = distinct_shingles(batch.column(1), size)
                ends = np.r_[0, np.cumsum(np.bincount(who, minlength=batch.num_rows))].astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["nid", "sets"])

    return texts.mapInArrow(run, "nid long, sets array<long>")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have Jaccard similarity ``least`` or more.  No text moves here."""
    left = sets.select(F.col("nid").alias("a"), F.col("sets").alias("sa"))
    right = sets.select(F.col("nid").alias("b"), F.col("sets").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    near = both >= F.lit(least) * (F.size("sa") + F.size("sb") - both) - 1e-9
    return pairs.join(left, "a").join(right, "b").where((both > 0) & near).select("a", "b")


def sizes_fit(x: str, y: str, least: float) -> Column:
    """Sets of these sizes can have similarity ``least``."""
    return F.least(x, y) >= F.lit(least) * F.greatest(x, y) - 1e-9


def rare_pairs(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of members(nid, label) of different labels that can have similarity ``least``: none is left out.

    Shingles are ordered by how many members hold them; those of more than COMMON members come last, in the order of
    their hashes.  Of two similar sets, the first shingle in common is among the n - ceil(least n) + 1 first of both
    (prefix filter, right for any one order), and what follows it in each is as long as the overlap that they need
    (positional filter).  Only members outside a shingle's largest label look for partners, and the partners are dealt
    in blocks, so neither a linked group nor a hot shingle makes one long task.
    """
    whole = members.join(sets, "nid")
    held = written(whole.select("nid", F.explode("sets").alias("h")), "shingles")
    often = held.groupBy("h").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") <= COMMON)
    rare = held.join(often, "h").groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("rare"))
    rare = whole.join(rare, "nid", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<struct<often: bigint, h: bigint>>")))
    common = F.transform(F.sort_array(F.array_except("sets", F.transform("rare", lambda e: e["h"]))), lambda h: F.struct(F.lit(COMMON + 1).cast("bigint").alias("often"), h.alias("h")))
    ordered = rare.select("nid", "label", F.size("sets").alias("n"), F.concat("rare", common).alias("all"))
    prefix = F.expr(f"slice(all, 1, cast(n - ceil({least!r}D * n - 1e-6D) + 1 AS INT))")
    entries = ordered.select("nid", "label", "n", F.posexplode(prefix).alias("at", "e")).where("e.often > 1")
    entries = written(entries.select(F.col("e.h").alias("h"), "nid", "label", "n", (F.col("n") - F.col("at")).alias("rest")), "entries")
    groups = entries.groupBy("h", "label").agg(F.count(F.lit(1)).alias("m"))
    groups = groups.groupBy("h").agg(F.sum("m").alias("m"), F.max(F.struct("m", "label")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    groups = written(groups.select("h", F.col("top.label").alias("top"), F.ceil(F.col("m") / SHINGLE_BLOCK).cast("int").alias("blocks")), "groups")
    # stored, so that the join by shingle is between plain rows and Spark can split a hot one
    ours = written(entries.join(groups, "h"), "entries")
    left = ours.where("label <> top").select("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.struct("nid", "label", "n", "rest").alias("x"))
    right = ours.select("h", F.expr("cast(pmod(xxhash64(nid), blocks) AS INT)").alias("block"), F.struct("nid", "label", "n", "rest").alias("y"))
    fits = F.least("x.rest", "y.rest") >= least / (1 + least) * (F.col("x.n") + F.col("y.n")) - 1e-6
    met = left.join(right, (left["h"] == right["h"]) & (left["block"] == right["block"]) & (F.col("x.label") != F.col("y.label")) & fits)
    out = written(met.select(F.least("x.nid", "y.nid").alias("a"), F.greatest("x.nid", "y.nid").alias("b")).distinct(), "pairs")
    dropped(held, entries, groups, ours)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(nid, label): the smallest node of each node's component, by label spreading with pointer jumping.

    Every round is written to the shared folder, and the one before deleted; the rounds grow with the logarithm of
    the longest path.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "nid"), "labels")
    while True:
        near = both.join(labels.select(F.col("nid").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        step = labels.join(near.withColumnRenamed("a", "nid"), "nid").select("nid", F.least("label", "l").alias("next"), F.col("label").alias("was"))
        jump = labels.select(F.col("nid").alias("next"), F.col("label").alias("up"))
        step = step.join(jump, "next", "left").select("nid", F.least("next", F.coalesce("up", "next")).alias("label"), "was")
        after = written(step, "labels")
        dropped(labels)
        labels = after
        if labels.where("label < was").isEmpty():
            dropped(both)
            return labels


def bridged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(nid, label) after further ``edges``: the components are contracted, so only links between them count.

    At most BRIDGES of those are few enough for one task; more go through ``components``.
    """
    to = labels.select("nid", "label")
    for end in ("a", "b"):
        edges = edges.join(to.withColumnRenamed("nid", end).withColumnRenamed("label", f"l{end}"), end, "left")
    ends = [F.coalesce("la", "a"), F.coalesce("lb", "b")]
    bridges = written(edges.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).where("a <> b").distinct(), "bridges")
    n = bridges.count()
    roots = bridges.coalesce(1).mapInArrow(_joined, "nid long, label long") if n <= BRIDGES else components(bridges)
    roots = written(roots.select(F.col("nid").alias("label"), F.col("label").alias("root")), "roots")
    # a bridge may end in a node that had no link before, which has no label yet
    alone = roots.select(F.col("label").alias("nid"), F.col("root").alias("label")).join(to, "nid", "left_anti")
    out = written(to.join(roots, "label", "left").select("nid", F.coalesce("root", "label").alias("label")).unionByName(alone), "labels")
    dropped(bridges, roots)
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest node of each node's component, in one pass over all edges."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    names = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([find(x) for x in names], pa.int64())], ["nid", "label"])


def near_classes(
    docs: DataFrame, least: float = 0.8, size: int = 5, k: int = 160, bands: int = 32, weighted: bool = False, exact: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, class_id, class_docs, copies, tkey (of the text) and class_node for every row.

    Equal texts are one node; nodes whose shingle sets are similar by ``least`` or more are linked; a class is a
    connected component, named by the smallest id in it.  Null counts as the empty text; texts without words are
    linked to equal texts only; a class whose ids are all null has a null name.  Repeated rows each give a row.
    Other columns are ignored; an empty table gives no rows.  A text is hashed whole, however long; one worker holds
    its hashes.

    Candidates share a band of their DartMinHash signature.  In a band's bucket every member is held against the
    bucket's centre (the member that shares most with others), so a bucket of n costs n pairs, not n squared.  Then
    members of different components that share a bucket of at most SMALL_BUCKET are held against each other, and the
    members of larger buckets that hold several components meet in an exact join on their rare shingles
    (``rare_pairs``).  So two similar texts that share a band are always linked, whatever the bucket's size.  Every
    link is verified on the whole sets of shingles.  ``exact`` has all nodes meet in that join after the bands, so
    that no link depends on a shared band; it explodes every shingle of the table once.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(text.cast("binary")).alias("tkey"), text.alias("text"))
    sig = banded(rows, k, bands, size, kind, weighted)
    nodes = sig.groupBy("tkey").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("nid"), "*"), "nodes")
    spread = nodes.select("nid", "n", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    buckets = written(spread.join(shared, "key"), "buckets")
    rank = buckets.groupBy("nid").agg(F.sum("m").alias("centre"))
    members = written(buckets.join(rank, "nid").select("key", "nid", "n", "centre"), "members")
    dropped(buckets)

    wanted = nodes.where("n > 0") if exact else nodes.join(members.select("nid").distinct(), "nid", "left_semi")
    wanted = wanted.select("nid", "tkey", "rep")
    few = wanted.count() <= BROADCAST_NODES
    wanted = F.broadcast(wanted) if few else wanted
    texts = rows.join(wanted, (rows["tkey"] == wanted["tkey"]) & rows["doc_id"].eqNullSafe(wanted["rep"])).select("nid", "text")
    sets = written(shingle_sets(texts.dropDuplicates(["nid"]), size), "sets")

    def ordered(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    central = F.struct(F.col("centre"), (-F.col("nid")).alias("neg"), F.col("n"))
    heads = members.groupBy("key").agg(F.max(central).alias("head")).select("key", (-F.col("head.neg")).alias("b"), F.col("head.n").alias("m"))
    pairs = members.join(heads, "key").where((F.col("nid") != F.col("b")) & sizes_fit("n", "m", least))
    tested = written(pairs.select(*ordered("nid", "b")).distinct(), "pairs")
    edges = written(verified(tested, sets, least), "links")
    labels = components(edges)

    named = members.join(labels.select("nid", "label"), "nid", "left")
    named = written(named.select("key", "nid", "n", F.coalesce("label", "nid").alias("label")), "named")
    mixed = named.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", "m")
    small = named.join(mixed.where(F.col("m") <= SMALL_BUCKET), "key")
    other = small.select("key", F.col("nid").alias("b"), F.col("label").alias("other"), F.col("n").alias("o"))
    last = small.withColumnRenamed("nid", "a").join(other, "key")
    last = last.where((F.col("a") < F.col("b")) & (F.col("label") != F.col("other")) & sizes_fit("n", "o", least)).select("a", "b")
    large = named.join(mixed.where(F.col("m") > SMALL_BUCKET), "key").select("nid", "label").distinct()
    if exact:
        large = sets.join(labels.select("nid", "label"), "nid", "left").select("nid", F.coalesce("label", "nid").alias("label"))
    stuck = written(large, "stuck")
    met = rare_pairs(stuck, sets, least)
    last = written(last.unionByName(met).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    more = written(verified(last, sets, least), "links")
    if not more.isEmpty():
        before, labels = labels, bridged(labels, more)
        dropped(before)

    node_class = nodes.select("nid", "tkey", "rep", "copies").join(labels.select("nid", "label"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    classes = node_class.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_docs"))
    result = node_class.join(classes, "label").select("tkey", "class_id", "class_docs", "copies", F.col("label").alias("class_node"))
    result = written(result, "classes")
    dropped(nodes, members, sets, tested, edges, labels, named, stuck, met, last, more)
    return rows.select("doc_id", "tkey").join(result, "tkey").select("doc_id", "class_id", "class_docs", "copies", "tkey", "class_node")
