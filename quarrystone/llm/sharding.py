"""Sharding by proportional stratified interleaving.  Native DataFrame operations only; texts are never shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, ranked, written


def interleaved_shards(
    docs: DataFrame, n_shards: int = 24, seed: str = "interleave-1", id_col: str = "doc_id", text_col: str = "text",
    stratum_col: str = "source",
) -> DataFrame:
    """doc_id, size, text_crc32, source, pos, shard, slot for every row: shard sizes differ by one row at most.

    Rows of a source are shuffled by a hash of seed, id, checksum, size and, for rows equal in all of these, their
    number among them, and ranked; row r (from 0) of n has fractional rank (r + u) / n, u being the source's own
    seeded offset in [0, 1); rows in the order of fractional rank are cut into ``n_shards`` runs, so each shard holds
    every source in proportion.  Null source is a source of its own; a null text has size 8 and the checksum of
    nothing; a null id is shuffled as the empty id.  Texts of any length are only measured and summed.  Other columns
    are ignored, an empty table gives no rows.  Ranks are taken in buckets (``ranked``) of distinct hashes and
    offsets, so neither a hot source, nor repeated rows, nor many tiny sources, nor the global order meet in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col(stratum_col).cast("string")), F.lit("")).alias("stratum"),
        F.xxhash64(F.lit(seed), own, F.crc32(text.cast("binary")), F.octet_length(text)).alias("row"),
        F.monotonically_increasing_id().alias("uid"),
    )
    base = written(base, "shard-rows")  # the texts are read once; narrow rows serve all that follows
    n = base.count()
    buckets = bucket_count(n)

    def part(h: Column | str) -> Column:
        """The first 24 bits of a digest as a share of 1."""
        return F.conv(F.substring(h, 1, 6), 16, 10).cast("double") / F.lit(float(1 << 24))

    tied = written(base.groupBy("stratum", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("stratum", "row"), "tied-rows")
    if tied.isEmpty():
        base = base.withColumn("copy", F.lit(0).cast("long"))
    else:
        same = base.join(tied, ["stratum", "row"], "left_semi")
        same = ranked(same, ["stratum", "row"], F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int"), [F.col("uid")], "copy")
        base = base.join(tied, ["stratum", "row"], "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(same)
    base = base.withColumn("h", F.md5(F.concat_ws(":", "row", "copy").cast("binary")))
    by_hash = F.floor(part("h") * buckets).cast("int")
    last = [F.col("h")]
    strata = base.groupBy("stratum").agg(F.count(F.lit(1)).alias("stratum_rows"))
    inside = ranked(base, ["stratum"], by_hash, last, "r").join(strata, "stratum")
    offset = part(F.md5(F.concat(F.lit(seed + "/"), F.col("stratum")).cast("binary")))
    inside = inside.withColumn("frac", (F.col("r") + offset) / F.col("stratum_rows").cast("double"))
    inside = inside.withColumn("all", F.lit(0))
    by_frac = F.least(F.floor(F.col("frac") * buckets), F.lit(buckets - 1)).cast("int")
    out = ranked(inside, ["all"], by_frac, [F.col("frac"), F.col("stratum"), *last], "pos")
    shard = F.expr(f"cast((pos * {n_shards}) div {max(n, 1)} as int)")
    return (
        out.withColumn("shard", shard)
        .withColumn("slot", F.expr(f"pos - ((cast(shard as bigint) * {n} + {n_shards - 1}) div {n_shards})"))
        .withColumn("source", F.expr("if(stratum = '', null, substring(stratum, 2))"))
        .select("doc_id", "size", "text_crc32", "source", "pos", "shard", "slot")
    )
