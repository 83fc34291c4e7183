"""Reports, comparisons of statistical models, and the smaller views."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelight.operators import grade as G
from tracelight.operators import ranks
from tracelight.plans.registry import query, table
from tracelight.plans.scan_queries import _HISTORY_SQL, _STATUS_SQL, _TALLY_SQL, _history, found, sites, statuses
from tracelight.operators import detect as D


@query("WITH own AS (SELECT source, sha256(string_agg(md5(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY source), rel AS (SELECT source, CASE WHEN source = 'src3' THEN 'x' ELSE h END AS h, CASE WHEN source = 'src5' THEN 2 ELSE 1 END AS version FROM own WHERE source <> 'src7') SELECT o.source, CASE WHEN r.source IS NULL THEN 'no-release' WHEN r.version <> 1 THEN 'not-comparable' WHEN r.h = o.h THEN 'match' ELSE 'no-match' END AS fingerprint FROM own o LEFT JOIN rel r ON r.source = o.source")
def fingerprint_check(spark, sf_dir):
    """The fingerprint of each tree against the one that its release declares."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.md5("text").alias("h")))), lambda r: r["h"])
    own = table(spark, sf_dir, "documents").groupBy("source").agg(F.sha2(F.array_join(lines, ""), 256).alias("h"))
    declared = own.where("source <> 'src7'").select("source", F.when(F.col("source") == "src3", "x").otherwise(F.col("h")).alias("d"), F.when(F.col("source") == "src5", 2).otherwise(1).alias("version"))
    word = F.when(F.col("d").isNull(), "no-release").when(F.col("version") != 1, "not-comparable").when(F.col("d") == F.col("h"), "match").otherwise("no-match")
    return own.join(declared, "source", "left").select("source", word.alias("fingerprint"))


@query("SELECT source, doc_id, r::INT AS place, r <= greatest(1, ceil(48.0 / (SELECT count(DISTINCT source) FROM documents)))::INT AS within_share FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(text), doc_id) AS r FROM documents)")
def share_ladder_rank(spark, sf_dir):
    """A file's even share of 48 sites over the files bounds the greedy choice from above."""
    df = table(spark, sf_dir, "documents").select("source", "doc_id", F.md5("text").alias("priority"))
    share = df.agg(F.greatest(F.lit(1), F.ceil(48 / F.count_distinct("source"))).alias("share"))  # one row
    placed = ranks.rank_in_group(df, ["source"], F.substring("priority", 1, 2), ["priority", "doc_id"], "place")
    return placed.crossJoin(F.broadcast(share)).select("source", "doc_id", F.col("place").cast("int").alias("place"), (F.col("place") <= F.col("share")).alias("within_share"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS same FROM conversations) WHERE same")
def adjacent_duplicates(spark, sf_dir):
    """W12."""
    same = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")) == F.col("role")
    return table(spark, sf_dir, "conversations").withColumn("same", same).where("same").select("conv_id", "turn")


@query("SELECT page_id, array_to_string(list_reverse(list_slice(list_reverse(string_split(url, '/')), 1, 5)), '/') AS tail FROM pages")
def last_segments(spark, sf_dir):
    """The last five segments of a path."""
    parts = F.split("url", "/")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(5)), F.lit(5)), "/").alias("tail"))


@query("SELECT o_orderkey, array_to_string(turned, ',') AS families, list_filter(turned, lambda f: CASE f WHEN 'add' THEN o_orderkey > 16 WHEN 'sub' THEN o_custkey % 3 > 0 WHEN 'mul' THEN o_orderkey % 2 = 0 ELSE o_orderkey >= 1000 END)[1] AS taken FROM (SELECT o_orderkey, o_custkey, list_concat(list_slice(f, s + 1, 4), list_slice(f, 1, s)) AS turned FROM (SELECT o_orderkey, o_custkey, ['add', 'sub', 'mul', 'radix'] AS f, (o_custkey % 4)::INT AS s FROM orders))")
def family_rotation(spark, sf_dir):
    """Families tried from a keyed start, and the first that will do."""
    f, s = F.array(*[F.lit(x) for x in ("add", "sub", "mul", "radix")]), (F.col("o_custkey") % 4).cast("int")
    fits = F.array_compact(F.array(F.when(F.col("o_orderkey") > 16, "add"), F.when(F.col("o_custkey") % 3 > 0, "sub"), F.when(F.col("o_orderkey") % 2 == 0, "mul"), F.when(F.col("o_orderkey") >= 1000, "radix")))
    df = table(spark, sf_dir, "orders").withColumn("turned", F.concat(F.slice(f, s + 1, F.lit(4)), F.slice(f, F.lit(1), s))).withColumn("fits", fits)
    return df.select("o_orderkey", F.array_join("turned", ",").alias("families"), F.get(F.filter("turned", lambda x: F.array_contains(F.col("fits"), x)), F.lit(0)).alias("taken"))


@query("SELECT avg(n) AS mean, round(var_samp(n) / avg(n), 9) AS dispersion, max(n)::BIGINT AS most FROM (SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1)")
def null_dispersion(spark, sf_dir):
    """Mean and variance-to-mean ratio of counts."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.avg("n").alias("mean"), F.round(F.var_samp("n") / F.avg("n"), 9).alias("dispersion"), F.max("n").alias("most"))


_BINOMIAL = "list_sum(list_transform(range(k, n + 1), lambda i: factorial(n::INT) / (factorial(i::INT) * factorial((n - i)::INT)) * pow(p, i) * pow(1 - p, n - i)))"


@query(f"SELECT k, p, round({_BINOMIAL}, 9) AS tail FROM (SELECT DISTINCT l_linenumber::BIGINT AS k, 12::BIGINT AS n, (l_quantity / 60)::DOUBLE AS p FROM lineitem)")
def binomial_tail(spark, sf_dir):
    """The chance of k or more of twelve equal draws, by adding up one draw after another."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("k"), (F.col("l_quantity") / 60).alias("p")).distinct()
    return df.select("k", "p", F.round(draws_tail(F.array_repeat(F.col("p"), 12), F.col("k")), 9).alias("tail"))


def draws_tail(chances, k):
    """Probability that ``k`` or more of independent draws hit; a fold over the distribution of hits."""
    start = F.array(F.lit(1.0))
    step = lambda acc, p: F.zip_with(F.concat(F.transform(acc, lambda x: x * (1 - p)), F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), F.transform(acc, lambda x: x * p)), lambda a, b: a + b)
    total = lambda acc: F.aggregate(F.slice(acc, k.cast("int") + 1, F.size(acc)), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(chances, start, step, total)


@query(f"WITH {_TALLY_SQL} SELECT release_id, item FROM (SELECT release_id, unnest(list_filter([CASE WHEN fragments > 0 THEN 'keyed-fragments' END, CASE WHEN exact > 0 THEN 'exact-renderings' END, CASE WHEN moved > 0 THEN 'moved-sites' END, CASE WHEN stripped > 0 THEN 'stripped-sites' END, CASE WHEN fragments > 0 AND fragments < sites THEN 'partial-constellation' END], lambda x: x IS NOT NULL)) AS item FROM tally)")
def release_evidence(spark, sf_dir):
    """What a tally says about its release, one row a kind."""
    t = D.release_tally(statuses(spark, sf_dir))
    c = F.col
    kinds = {"keyed-fragments": c("fragments") > 0, "exact-renderings": c("exact") > 0, "moved-sites": c("moved") > 0, "stripped-sites": c("stripped") > 0, "partial-constellation": (c("fragments") > 0) & (c("fragments") < c("sites"))}
    return t.select("release_id", F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in kinds.items()]))).alias("item"))


@query(f"WITH {_STATUS_SQL} SELECT release_id, site, kind, kind <> 'site-elsewhere' AS asserts FROM (SELECT release_id, site, unnest(list_filter([['', 'site-location', 'site-code', 'site-rendering'][(rank + 1)::INT], CASE WHEN rank >= 2 AND found_in <> own THEN 'site-elsewhere' END], lambda x: x IS NOT NULL AND x <> '')) AS kind FROM status)")
def site_evidence(spark, sf_dir):
    """Up to two items a site, and whether each asserts provenance."""
    word = F.when(F.col("rank") == 1, "site-location").when(F.col("rank") == 2, "site-code").when(F.col("rank") == 3, "site-rendering")
    away = F.when((F.col("rank") >= 2) & (F.col("found_in") != F.col("own_file")), "site-elsewhere")
    items = statuses(spark, sf_dir).select("release_id", "site", F.explode(F.array_compact(F.array(word, away))).alias("kind"))
    return items.withColumn("asserts", F.col("kind") != "site-elsewhere")


@query("SELECT doc_id, total - 24 AS omitted FROM (SELECT doc_id, count(*) OVER () AS total FROM documents ORDER BY doc_id LIMIT 24)")
def head_with_omitted(spark, sf_dir):
    """The first rows of a listing, and how many are left out."""
    df = table(spark, sf_dir, "documents").select("doc_id")
    total = df.agg((F.count(F.lit(1)) - 24).alias("omitted"))
    return df.orderBy("doc_id").limit(24).crossJoin(F.broadcast(total))


@query(f"WITH {_HISTORY_SQL} SELECT release_id, sites::BIGINT AS sites FROM history WHERE release_id LIKE '%-0_' OR sites > (SELECT avg(sites) FROM history)")
def registry_search(spark, sf_dir):
    """Releases by id or by size."""
    h = _history(spark, sf_dir)
    mean = h.agg(F.avg("sites").alias("mean"))
    return h.crossJoin(F.broadcast(mean)).where("release_id like '%-0_' or sites > mean").select("release_id", "sites")


@query("WITH placed AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents), picked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY i) AS k FROM placed WHERE i % 3 < 2) SELECT source, count(*)::BIGINT AS files, sum(n_chars)::BIGINT AS chars FROM picked WHERE k <= greatest(ceil(n * 2 / 3.0), 1) GROUP BY source")
def tree_fraction(spark, sf_dir):
    """X28, whose result is two thirds of each tree by place, rounded up and one at least: here its size."""
    picked = ranks.fraction(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], F.expr("doc_id div 4096"), ["doc_id"], 2, 3)
    return picked.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"))


@query("SELECT c_custkey, CASE WHEN s.s_nationkey IS NULL THEN 'unknown' WHEN s.pin = c.pin THEN 'pinned' ELSE 'differs' END AS pin FROM (SELECT c_custkey, c_nationkey, c_custkey % 3 AS pin FROM customer) c LEFT JOIN (SELECT s_nationkey, min(s_suppkey) % 3 AS pin FROM supplier GROUP BY 1) s ON s.s_nationkey = c.c_nationkey")
def registry_pins(spark, sf_dir):
    """What a registry pins against what is found."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 3).alias("own"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg((F.min("s_suppkey") % 3).alias("told"))
    word = F.when(F.col("told").isNull(), "unknown").when(F.col("told") == F.col("own"), "pinned").otherwise("differs")
    return c.join(s, "k", "left").select("c_custkey", word.alias("pin"))


@query("SELECT l_orderkey, l_linenumber, l_partkey = o.p AND l_suppkey = o.s AS relocated FROM lineitem l JOIN (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2) o ON o.k = l_orderkey AND o.n = l_linenumber")
def relocated_candidates(spark, sf_dir):
    """Candidates found again by a composite key."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    best = l.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    return l.join(best, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", ((F.col("l_partkey") == F.col("p")) & (F.col("l_suppkey") == F.col("s"))).alias("relocated"))


@query("SELECT source, round(coalesce(count(*) FILTER (WHERE n_chars > 1000) / count(*), 0), 6) AS density, count_if(n_chars <= 1000)::BIGINT AS refused FROM documents GROUP BY source")
def site_density(spark, sf_dir):
    """A4, A5."""
    good = F.count_if(F.col("n_chars") > 1000)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.coalesce(F.try_divide(good, F.count(F.lit(1))), F.lit(0.0)), 6).alias("density"), F.count_if(F.col("n_chars") <= 1000).alias("refused"))


@query("SELECT sum(octet_length(encode(text)))::BIGINT AS bytes, count_if(n_chars > 20000)::BIGINT AS unexamined, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM documents")
def scan_totals(spark, sf_dir):
    """A24."""
    return table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(F.col("n_chars") > 20000).alias("unexamined"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))


@query("SELECT role, CASE WHEN length(text) > 76 THEN 'long' ELSE 'short' END AS class, count(*)::BIGINT AS n, grouping(role, CASE WHEN length(text) > 76 THEN 'long' ELSE 'short' END)::BIGINT AS level FROM conversations GROUP BY GROUPING SETS ((role), (CASE WHEN length(text) > 76 THEN 'long' ELSE 'short' END), ())")
def summary_sets(spark, sf_dir):
    """Counts of a summary by several groupings at once."""
    df = table(spark, sf_dir, "conversations").select("role", F.when(F.length("text") > 76, "long").otherwise("short").alias("class"))
    return df.groupingSets([["role"], ["class"], []], "role", "class").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query(f"WITH {_TALLY_SQL} SELECT release_id, fragments = sites AND files > 1 AS full, fragments > 0 AS lead FROM tally")
def finding_flags(spark, sf_dir):
    """P13, P16, X29."""
    return D.release_tally(statuses(spark, sf_dir)).select("release_id", ((F.col("fragments") == F.col("sites")) & (F.col("files") > 1)).alias("full"), (F.col("fragments") > 0).alias("lead"))


@query("SELECT b.item_id AS site, count(DISTINCT d.doc_id % 16)::BIGINT AS codes FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def distinct_codes(spark, sf_dir):
    """A11, over word-for-word observations."""
    return found(spark, sf_dir).where("exact").groupBy("site").agg(F.count_distinct("code").alias("codes"))


@query(f"SELECT o_orderkey, round(1 - pow(1 - pow(0.5, w), d), 9) AS chance FROM (SELECT o_orderkey, o_custkey % 7 + 2 AS w, o_orderkey % 9 AS d FROM orders)")
def site_chance(spark, sf_dir):
    """One site's chance to be met by accident."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7 + 2).alias("w"), (F.col("o_orderkey") % 9).alias("d"))
    return df.select("o_orderkey", F.round(G.site_chance(F.col("d"), F.col("w")), 9).alias("chance"))
