"""Which protected passages stand in which candidates: hypotheses, observations, status, tally, report.

A *site* is a passage of a release (``release_id, site, text, expected`` code of ``width`` bits).  A
*candidate* is ``file, text``.  Both give keys, the hashes of their runs of ``SHINGLE`` words; equal keys
make an observation.  The table of keys is small beside the candidates and is broadcast if its counted
size allows, and joined by a shuffle if not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelight.operators import grade as G

SHINGLE = 8
MOST_OBSERVATIONS = 64
BROADCAST_KEYS = 200_000


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda w: w != "")


def shingle_keys(df: DataFrame, *ids: str, k: int = SHINGLE) -> DataFrame:
    """``ids, key``: the distinct hashes of the runs of ``k`` words of each text.

    The words are a column of their own: inside a lambda their expression would run for every run.
    """
    words = df.select(*ids, word_list(F.col("text")).alias("_w")).where(F.size("_w") >= k)
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - (k - 1)), lambda i: F.xxhash64(F.slice("_w", i, F.lit(k))))
    return words.select(*ids, F.explode(F.array_distinct(runs)).alias("key"))


def observations(candidates: DataFrame, sites: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``release_id, site, file, hits, exact``: one row for each site and file that share a key.

    The hits are kept (they are few beside the candidates) and counted; up to ``BROADCAST_KEYS`` of them
    travel to the texts for the word-for-word test, so that no text is shuffled.
    """
    keys = shingle_keys(sites, "release_id", "site", k=k)
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    asked = shingle_keys(candidates, "file", k=k)
    hits = asked.join(F.broadcast(keys) if few else keys, "key").groupBy("release_id", "site", "file").agg(F.count_distinct("key").alias("hits")).persist()
    passages = sites.select("release_id", "site", F.col("text").alias("_s"))
    wanted = hits.join(F.broadcast(passages) if few else passages, ["release_id", "site"])
    slim = hits.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    whole = candidates.select("file", F.col("text").alias("_c")).join(F.broadcast(wanted) if slim else wanted, "file")
    return whole.select("release_id", "site", "file", "hits", F.contains("_c", F.col("_s")).alias("exact"))


def capped(observed: DataFrame, most: int = MOST_OBSERVATIONS) -> DataFrame:
    """The first observations of a site by ``seq``; a later exact one takes the place of the first that is not."""
    w = W.partitionBy("release_id", "site").orderBy("seq")
    numbered = observed.withColumn("_r", F.row_number().over(w))
    late = F.count_if((F.col("_r") > most) & F.col("exact")).over(W.partitionBy("release_id", "site"))
    plain = F.sum(F.when(~F.col("exact"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    numbered = numbered.withColumn("_late", late).withColumn("_plain", plain)
    late_rank = F.sum(F.when((F.col("_r") > most) & F.col("exact"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    numbered = numbered.withColumn("_late_rank", late_rank)
    room = F.count_if((F.col("_r") <= most) & ~F.col("exact")).over(W.partitionBy("release_id", "site"))
    numbered = numbered.withColumn("_room", room)
    early = (F.col("_r") <= most) & (F.col("exact") | (F.col("_plain") > F.col("_late")))
    forced = (F.col("_r") > most) & F.col("exact") & (F.col("_late_rank") <= F.col("_room"))
    return numbered.where(early | forced).drop("_r", "_late", "_plain", "_late_rank", "_room")


def site_status(sites: DataFrame, observed: DataFrame) -> DataFrame:
    """One row a site: its status, where it was found, and how many codes were read there.

    Observations (``release_id, site, seq, file, exact, code``) are read in the order of ``seq``; the
    first exact one ends the reading.  Without one the first whose code is the expected one confirms the
    site; without that the first of all marks its place.
    """
    by = ["release_id", "site"]
    o = observed.join(sites.select(*by, "expected", F.col("file").alias("own_file")), by)
    rank = F.when(F.col("exact"), 3).when(F.col("code") == F.col("expected"), 2).otherwise(1)
    o = o.withColumn("rank", rank)
    stop = F.min(F.when(F.col("exact"), F.col("seq"))).over(W.partitionBy(*by))
    o = o.withColumn("stop", stop).where("stop is null or seq <= stop")
    found = o.groupBy(*by).agg(
        F.max("rank").alias("rank"),
        F.min(F.struct((-F.col("rank")).alias("r"), "seq", "file")).alias("best"),
        F.min(F.when(F.col("file") == F.col("own_file"), F.struct((-F.col("rank")).alias("r"), "seq", "file"))).alias("home"),
        F.count(F.lit(1)).alias("probes"),
        (F.count_distinct("code") + F.count_if(F.col("code").isNull())).alias("codes"),
    )
    all_sites = sites.select(*by, "width", "expected", F.col("file").alias("own_file")).join(found, by, "left")
    at_home = (F.col("home.r") <= F.col("best.r")) & F.col("home").isNotNull()
    place = F.when(at_home, F.col("home.file")).otherwise(F.col("best.file"))
    status_rank = F.coalesce("rank", F.lit(0))
    codes = F.when(status_rank == 3, F.col("probes")).otherwise(F.coalesce("codes", F.lit(0)))
    return all_sites.select(
        *by, "width", "own_file", status_rank.alias("rank"), F.element_at(F.array(*[F.lit(s) for s in G.STATUSES]), status_rank + 1).alias("status"),
        place.alias("found_in"), F.coalesce("probes", F.lit(0)).cast("long").alias("probes"), codes.cast("long").alias("distinct_codes"),
    )


def release_tally(status: DataFrame) -> DataFrame:
    """One row a release: counts, bits, coverage, chance and level."""
    confirmed = F.col("rank") >= 2
    t = status.groupBy("release_id").agg(
        F.count(F.lit(1)).alias("sites"),
        F.count_if(confirmed).alias("fragments"),
        F.count_if(F.col("rank") == 3).alias("exact"),
        F.count_if(F.col("rank") == 1).alias("stripped"),
        F.count_if(F.col("rank") == 0).alias("absent"),
        F.count_if(confirmed & (F.col("found_in") != F.col("own_file"))).alias("moved"),
        F.coalesce(F.sum(F.when(confirmed, F.col("width"))), F.lit(0)).cast("long").alias("bits"),
        F.count_distinct(F.when(confirmed, F.col("found_in"))).alias("files"),
        F.sum("probes").cast("long").alias("probes"),
        F.sum(G.site_chance(F.col("distinct_codes"), F.col("width"))).alias("mean"),
    )
    t = t.withColumn("coverage", F.round(F.try_divide(F.col("fragments"), F.col("sites")), 6))
    return t.withColumn("probability", G.poisson_tail(F.col("mean"), F.col("fragments")))


def graded(tally: DataFrame) -> DataFrame:
    """The tally with level and outcome of each release, as if it were the strongest."""
    no = F.lit(False)
    t = tally.withColumn("level_rank", G.level_rank(F.col("fragments"), F.col("files"), no, F.col("probability")))
    clears = G.clears_chance(F.col("level_rank"), no, F.col("probability"))
    return t.withColumn("level", G.level_word(F.col("level_rank"))).withColumn("outcome", G.outcome(F.col("level_rank"), clears, no))
