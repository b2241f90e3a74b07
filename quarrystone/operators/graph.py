"""Entity graph: links, administrative groups, leader/follower relations, counterparties."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import PPM, trunc_div
from ..functions.stats import sorted_list, upper_median


def shared_dir(spark) -> str:
    """The session's checkpoint folder; only a local session without one gets its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = tempfile.mkdtemp(prefix="quarrystone-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): labels spread, then jump to their label's label.

    A round is stored and the one before deleted, so lineage stays short and a lost executor costs one round; rounds are about the logarithm
    of the longest path.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("l"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "l").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("up"))
        done = stored(step.join(up, "next", "left").select("node", F.col("label").alias("was"), F.least("next", F.coalesce("up", "next")).alias("label")))
        dropped(labels)
        labels = done
        if labels.where("label < was").isEmpty():
            dropped(both)
            return labels.select("node", F.col("label").alias("component"))


def soft_merge(families: Column, posterior_ppm: Column, least_families: int = 2, least_ppm: int = 800_000) -> Column:
    """Enough distinct soft evidence families and a high enough posterior."""
    soft = F.filter(F.array_distinct(families), lambda f: f != "Hard")
    return (F.size(soft) >= least_families) & (posterior_ppm >= least_ppm)


def effective_votes(weights_sum: Column) -> Column:
    """Sum of ppm weights, rounded half up."""
    return trunc_div(weights_sum + 500_000, F.lit(PPM))


def relation_class(p: Column, n: Column, similar: Column, contrarian: Column, controlled: Column, lag: Column, fast: int) -> Column:
    return (
        F.when(controlled, "IndependentConfirmer").when((similar == 0) & (contrarian * 2 >= n), "Contrarian")
        .when((p >= 800_000) & (lag <= fast // 4), "CopyBot").when((p >= 600_000) & (lag <= fast), "FastFollower").when(p >= 600_000, "SlowFollower")
        .when(p >= 400_000, "IndependentConfirmer").otherwise("NoStableRelation")
    )


def relations(matches: DataFrame, leaders: DataFrame, pair: list[str], fast: int) -> DataFrame:
    """Class of each pair from its matched actions (lag, same, opposite, small_move) and the leader's action count."""
    agg = matches.groupBy(*pair).agg(
        F.count(F.when(F.col("same"), 1)).alias("similar"), F.count(F.when(F.col("opposite"), 1)).alias("contrarian"),
        F.count(F.when(F.col("same") & F.col("small_move"), 1)).alias("small"), sorted_list("lag").alias("lags"),
    )
    t = agg.join(leaders, pair[0])
    p = trunc_div(F.col("similar") * PPM, "n")
    controlled = (F.col("similar") > 0) & (F.col("small") * 2 < F.col("similar"))
    lag = upper_median("lags")
    return t.select(*pair, "n", "similar", p.alias("probability_ppm"), lag.alias("median_lag"), relation_class(p, F.col("n"), F.col("similar"), F.col("contrarian"), controlled, lag, fast).alias("class"))


def emitted_links(subaccounts: DataFrame, vaults: DataFrame, block_times: DataFrame) -> DataFrame:
    """Certain links (a, b, kind, posterior_ppm, effective_at) from reconstructed state: subaccounts(master, subaccount,
    first_height) and vaults(account, vault, first_height), dated by block_times(height, time).  A height without a time
    raises."""
    rows = subaccounts.select(F.col("master").alias("a"), F.col("subaccount").alias("b"), F.lit("ProtocolSubaccount").alias("kind"), "first_height")
    rows = rows.unionByName(vaults.select(F.col("account").alias("a"), F.col("vault").alias("b"), F.lit("ProtocolVaultMembership").alias("kind"), "first_height"))
    timed = rows.join(block_times, rows["first_height"] == block_times["height"], "left")
    known = F.when(F.col("time").isNotNull(), F.col("time")).otherwise(F.raise_error(F.concat(F.lit("no time for height "), F.col("first_height").cast("string"))).cast("bigint"))
    return timed.select("a", "b", "kind", F.lit(1_000_000).alias("posterior_ppm"), known.alias("effective_at"))
