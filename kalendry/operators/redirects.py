"""Redirect chains over a table of answers, and the final address under which a page is known as well.

answers(url, location): what each address answered; location is null for a page, else where it sends the reader, as
written (relative to url). url is in its normal form, once each. Chains end after MOST hops: a longer one, a loop
among them, is `too many`; a hop to an address that must not be fetched is `refused`; an address without an answer is
`unknown`. Each round joins only the chains that still go on, by the address they stand at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendry.functions import addresses
from kalendry.sources.shared import written

MOST = 5


def targets(answers: DataFrame) -> DataFrame:
    """(url, to, refusal): where each answer leads, in normal form, and why a reader must not go there; to is null for pages."""
    full = addresses.resolved(F.col("location"), F.col("url"))
    hop = answers.select("url", F.col("location").isNotNull().alias("moves"), F.when(F.col("location").isNotNull(), full).alias("full"))
    refusal = F.when(F.col("moves"), F.when(F.col("full").isNull(), "host").otherwise(addresses.refusal(F.col("full"))))
    return hop.select("url", "moves", addresses.normal(F.col("full")).alias("to"), refusal.alias("refusal"))


def followed(starts: DataFrame, answers: DataFrame, most: int = MOST) -> DataFrame:
    """starts(url) -> url, outcome (page, too many, refused, unknown), final_url (of pages), hops (taken before it ended).

    Every start counts once. Many starts may meet in one address: they are reduced to the distinct addresses in each
    round, so a hub that everyone is sent to is joined as one row, and what it answers is handed back by address.
    """
    to = written(targets(answers), "targets")
    now = starts.select("url").distinct().withColumn("at", F.col("url"))
    ended = []
    for hop in range(most + 1):
        at = now.select("at").distinct().join(to.withColumnRenamed("url", "at"), "at", "left")
        met = written(now.join(at, "at").select("url", "at", "moves", "to", "refusal"), "hops")
        outcome = F.when(F.col("moves").isNull(), "unknown").when(~F.col("moves"), "page").when(F.lit(hop == most), "too many").when(F.col("refusal").isNotNull(), "refused")
        known = met.withColumn("outcome", outcome)
        ended.append(known.where("outcome is not null").select("url", "outcome", F.when(F.col("outcome") == "page", F.col("at")).alias("final_url"), F.lit(hop).alias("hops")))
        now = known.where("outcome is null").select("url", F.col("to").alias("at"))
    return reduce(DataFrame.unionByName, ended)


def aliases(found: DataFrame) -> DataFrame:
    """Every address under which a page may be asked for: (url, final_url), the final address itself among them."""
    pages = found.where("outcome = 'page'")
    return pages.select("url", "final_url").union(pages.select("final_url", "final_url")).distinct()
