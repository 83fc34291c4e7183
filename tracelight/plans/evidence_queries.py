"""The keyed scan end to end, and rules and agreements of the documents of a store.

The tree that is scanned is made of conversations: a turn is a statement, its scope is the turn with its
neighbours, and each conversation is a release whose sites are its turns.  The candidate is the same tree
with every conversation treated in one of four ways: left alone; respelled, with other literals of the
same codes; edited; or left alone with other codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelight.functions import keys as K
from tracelight.operators import detect as D
from tracelight.operators import grade as G
from tracelight.operators import rules as R
from tracelight.plans.key_queries import SITE_KEY, _sql_framed, _sql_hmac
from tracelight.plans.registry import ORACLE_SQL, query, table
from tracelight.plans.scan_queries import _STATUS_SQL

WIDTH = 4


def exact_text(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\r\n]+", " ")


def abstract_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " "))


def addresses(text: str, scope: str) -> Column:
    """The four keyed ids of a place, in the order of the slots."""
    digests = [abstract_text(F.col(text)), abstract_text(F.col(scope)), exact_text(F.col(text)), exact_text(F.col(scope))]
    return F.array(*[K.hex_lower(K.location_id(SITE_KEY, k, K.sha256(F.encode(d, "UTF-8")))) for k, d in enumerate(digests)])


def places(spark, sf_dir: str) -> DataFrame:
    """``release_id, site, way, file, locations, expected, rendered`` of each turn, and ``new_locations, literal`` of its candidate."""
    w = W.partitionBy("conv_id").orderBy("turn")
    way = F.col("conv_id") % 4
    changed = F.when(way == 1, F.concat("text", F.lit("!!"))).when(way == 2, F.concat(F.lit("Well then, "), "text")).otherwise(F.col("text"))
    df = table(spark, sf_dir, "conversations").withColumn("changed", changed)
    near = lambda c: F.concat(F.coalesce(F.lag(c).over(w), F.lit("")), F.lit("\n"), F.col(c), F.lit("\n"), F.coalesce(F.lead(c).over(w), F.lit("")))
    df = df.withColumn("scope", near("text")).withColumn("changed_scope", near("changed"))
    df = df.withColumn("locations", addresses("text", "scope")).withColumn("new_locations", addresses("changed", "changed_scope"))
    primary = F.unhex(F.element_at("locations", 3))
    df = df.withColumn("expected", K.fragment_tag(SITE_KEY, primary, WIDTH)).withColumn("value", F.length("text").cast("long") * 16)
    literal = F.col("value") + F.when(way == 1, F.col("expected") + 16).when(way == 3, (F.col("expected") + 1) % 16).otherwise(F.col("expected"))
    return df.select(
        F.concat(F.lit("rel-"), F.col("conv_id").cast("string")).alias("release_id"), (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("site"),
        way.alias("way"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("file"), "locations", "new_locations",
        "expected", (F.col("value") + F.col("expected")).alias("rendered"), literal.alias("literal"), F.lit(WIDTH).alias("width"),
    )


def index_of_addresses(sites: DataFrame) -> DataFrame:
    """``loc, slot, release_id, site, expected, rendered``: an address that several sites have is the first one's."""
    spread = sites.select(F.posexplode("locations").alias("slot", "loc"), "release_id", "site", "expected", "rendered")
    first = spread.groupBy("loc").agg(F.min(F.struct("site", "slot", "release_id", "expected", "rendered")).alias("s"))
    return first.select("loc", "s.*")


def keyed_hits(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Hypotheses (``seq, file, locations, literal``) that share an address with a site, one row for each pair."""
    spread = asked.select("seq", "file", "literal", F.explode(F.array_distinct("locations")).alias("loc"))
    hits = spread.join(index, "loc").groupBy("release_id", "site", "expected", "rendered", "seq", "file", "literal")
    hits = hits.agg(F.sort_array(F.collect_set("slot")).alias("slots"))  # at most four
    return hits.withColumn("exact", F.col("literal") == F.col("rendered")).withColumn("code", (F.col("literal") % 16).cast("int"))


def _hits(spark, sf_dir):
    p = places(spark, sf_dir)
    return keyed_hits(index_of_addresses(p), p.select(F.col("site").alias("seq"), "file", "literal", F.col("new_locations").alias("locations")))


def _loc_sql(slot: int, text: str) -> str:
    return "left(" + _sql_hmac(_sql_framed("location", f"unhex('{slot:02x}')", f"unhex(sha256({text}))")) + ", 32)"


def _addresses_sql(text: str, scope: str) -> str:
    exact = lambda x: f"regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g')"
    abstract = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z]+', ' ', 'g'))"
    return "[" + ", ".join(_loc_sql(k, x) for k, x in enumerate((abstract(text), abstract(scope), exact(text), exact(scope)))) + "]"


_TAG_SQL = "(('0x' || left(" + _sql_hmac(_sql_framed("tag", "unhex(locations[3])", "unhex('04')")) + ", 8))::BIGINT & 15)::INT"
_PLACES_SQL = f"""turns AS (SELECT *, CASE conv_id % 4 WHEN 1 THEN text || '!!' WHEN 2 THEN 'Well then, ' || text ELSE text END AS changed FROM conversations),
scoped AS (SELECT *, coalesce(lag(text) OVER w, '') || chr(10) || text || chr(10) || coalesce(lead(text) OVER w, '') AS scope, coalesce(lag(changed) OVER w, '') || chr(10) || changed || chr(10) || coalesce(lead(changed) OVER w, '') AS changed_scope FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
addressed AS (SELECT conv_id, turn, length(text)::BIGINT * 16 AS value, {_addresses_sql('text', 'scope')} AS locations, {_addresses_sql('changed', 'changed_scope')} AS new_locations FROM scoped),
tagged AS (SELECT *, {_TAG_SQL} AS expected FROM addressed),
places AS (SELECT 'rel-' || conv_id AS release_id, (conv_id * 1000 + turn)::BIGINT AS site, conv_id % 4 AS way, 'conv/' || conv_id AS file, locations, new_locations, expected, value + expected AS rendered, value + CASE conv_id % 4 WHEN 1 THEN expected + 16 WHEN 3 THEN (expected + 1) % 16 ELSE expected END AS literal FROM tagged),
spread AS (SELECT release_id, site, expected, rendered, k - 1 AS slot, locations[k] AS loc FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM places)),
indexed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY loc ORDER BY site, slot) AS r FROM spread) WHERE r = 1),
asked AS (SELECT DISTINCT site AS seq, file, literal, unnest(new_locations) AS loc FROM places),
hits AS (SELECT i.release_id, i.site, i.expected, i.rendered, a.seq, a.file, a.literal, list_sort(list(DISTINCT i.slot)) AS slots, a.literal = i.rendered AS exact, (a.literal % 16)::INT AS code FROM asked a JOIN indexed i USING (loc) GROUP BY ALL)"""


@query(f"WITH {_PLACES_SQL} SELECT release_id, site, seq, file, array_to_string(slots, '') AS slots, exact, code FROM hits")
def keyed_scan_hits(spark, sf_dir):
    """Recorded sites against hypotheses on any of four keyed ids, slots put together."""
    return _hits(spark, sf_dir).select("release_id", "site", "seq", "file", F.array_join(F.transform("slots", lambda x: x.cast("string")), "").alias("slots"), "exact", "code")


_KEYED_STATUS_SQL = f"""{_PLACES_SQL}, ranked AS (SELECT *, CASE WHEN exact THEN 3 WHEN code = expected THEN 2 ELSE 1 END AS rank, min(CASE WHEN exact THEN seq END) OVER (PARTITION BY release_id, site) AS stop FROM hits),
read AS (SELECT r.*, p.file AS own_file FROM ranked r JOIN places p USING (release_id, site) WHERE stop IS NULL OR seq <= stop),
best AS (SELECT release_id, site, max(rank) AS rank, arg_min(file, -rank::HUGEINT * 1000000000000000 + seq) AS place, max(CASE WHEN file = own_file THEN rank END) AS home, count(*) AS probes, count(DISTINCT code) AS codes FROM read GROUP BY 1, 2),
status AS (SELECT s.release_id, s.site, 4 AS width, coalesce(b.rank, 0) AS rank, CASE WHEN b.home = b.rank THEN s.file ELSE b.place END AS found_in, coalesce(b.probes, 0) AS probes, CASE WHEN b.rank = 3 THEN b.probes ELSE coalesce(b.codes, 0) END AS codes, s.file AS own FROM places s LEFT JOIN best b USING (release_id, site))"""


def _statuses(spark, sf_dir):
    seen = _hits(spark, sf_dir).select("release_id", "site", "seq", "file", "exact", "code")
    return D.site_status(places(spark, sf_dir).select("release_id", "site", "expected", "width", "file"), seen)


@query(f"WITH {_KEYED_STATUS_SQL} SELECT release_id, site, rank >= 2 AS watermark, ['absent', 'location-only', 'tag-confirmed', 'exact-rendering'][(rank + 1)::INT] AS status, found_in, probes::BIGINT AS probes, codes::BIGINT AS distinct_codes FROM status")
def observation_fold(spark, sf_dir):
    """The ordered fold of each site's observations, and whether it shows the watermark."""
    return _statuses(spark, sf_dir).select("release_id", "site", (F.col("rank") >= 2).alias("watermark"), "status", "found_in", "probes", "distinct_codes")


@query(ORACLE_SQL["scan_report"].replace(_STATUS_SQL, _KEYED_STATUS_SQL))
def scan_verdict(spark, sf_dir):
    """The keyed scan counted, held against chance and graded, one row a release."""
    g = D.graded(D.release_tally(_statuses(spark, sf_dir)))
    return g.select("release_id", "sites", "fragments", "files", F.round("mean", 9).alias("mean"), "level", "outcome")


@query(f"WITH {_PLACES_SQL} SELECT site, array_to_string(list_sort(list_distinct(flatten(list(slots)))), '') AS slots FROM hits GROUP BY site HAVING len(list_filter(flatten(list(slots)), lambda x: x < 2)) > 0 AND len(list_filter(flatten(list(slots)), lambda x: x >= 2)) = 0")
def refactored_sites(spark, sf_dir):
    """Sites met by an abstract address and by no exact one."""
    slots = _hits(spark, sf_dir).select("site", F.explode("slots").alias("slot")).groupBy("site").agg(F.sort_array(F.collect_set("slot")).alias("slots"))
    met = slots.where(F.exists("slots", lambda x: x < 2) & ~F.exists("slots", lambda x: x >= 2))
    return met.select("site", F.array_join(F.transform("slots", lambda x: x.cast("string")), "").alias("slots"))


@query(f"WITH {_PLACES_SQL} SELECT site, array_to_string(list_filter(list_transform([1, 2, 3, 4], lambda k: CASE WHEN locations[k] <> new_locations[k] THEN ['statement-abstract', 'scope-abstract', 'statement-exact', 'scope-exact'][k] END), lambda x: x IS NOT NULL), '+') AS drifted FROM places WHERE locations <> new_locations")
def drifted_keys(spark, sf_dir):
    """Which of the four addresses of a place are others after an edit."""
    df = places(spark, sf_dir).select("site", R.drifted(F.col("locations"), F.col("new_locations")).alias("d")).where(F.size("d") > 0)
    return df.select("site", F.array_join("d", "+").alias("drifted"))


@query(f"WITH {_PLACES_SQL}, one AS (SELECT locations[1] AS loc FROM places ORDER BY site LIMIT 1) SELECT site, expected FROM places, one WHERE list_contains(locations, one.loc)")
def sites_of_an_address(spark, sf_dir):
    """The sites that one id addresses, here the first site's, and the codes they expect."""
    p = places(spark, sf_dir)
    one = p.agg(F.min(F.struct("site", F.element_at("locations", 1).alias("loc"))).alias("s")).select("s.loc")  # one row
    return p.join(F.broadcast(one), F.array_contains("locations", F.col("loc"))).select("site", "expected")


@query(f"WITH {_PLACES_SQL} SELECT p.release_id, count(*)::BIGINT AS target, count(i.site)::BIGINT AS placed, count_if(i.site IS NULL)::BIGINT AS lost FROM places p LEFT JOIN (SELECT DISTINCT site FROM indexed WHERE slot = 2) i USING (site) GROUP BY 1")
def shortfall(spark, sf_dir):
    """X11: sites whose primary identity another site has taken are lost to the release."""
    p = places(spark, sf_dir)
    kept = index_of_addresses(p).where("slot = 2").select("site", F.lit(True).alias("kept")).distinct()
    return p.select("release_id", "site").join(kept, "site", "left").groupBy("release_id").agg(F.count(F.lit(1)).alias("target"), F.count("kept").alias("placed"), F.count_if(F.col("kept").isNull()).alias("lost"))


# -- documents of a store --------------------------------------------------------------------------

_RECORDS_SQL = """records AS (SELECT s_suppkey AS k, 'prj-' || s_nationkey AS project, sha256(s_name) AS fingerprint, s_suppkey % 3 + 1 AS level, sha256(s_name || s_suppkey) AS digest FROM supplier),
manifests AS (SELECT s_suppkey AS k, 'prj-' || (CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey + 1 ELSE s_nationkey END) AS project, sha256(CASE WHEN s_suppkey % 7 = 0 THEN s_name || 'x' ELSE s_name END) AS fingerprint, CASE WHEN s_suppkey % 11 = 0 THEN 9 ELSE s_suppkey % 3 + 1 END AS level, sha256(s_name || CASE WHEN s_suppkey % 13 = 0 THEN 0 ELSE s_suppkey END) AS digest FROM supplier WHERE s_acctbal > 1000),
plans AS (SELECT s_suppkey AS k, sha256(s_name || CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE s_suppkey END) AS digest FROM supplier WHERE s_suppkey % 4 <> 1)"""


def _documents(spark, sf_dir):
    s, k, name = table(spark, sf_dir, "supplier"), F.col("s_suppkey"), F.col("s_name")
    project = lambda n: F.concat(F.lit("prj-"), n.cast("string"))
    digest = lambda other: F.sha2(F.concat(name, F.when(k % other == 0, F.lit(0)).otherwise(k).cast("string")), 256)
    records = s.select(k.alias("release_id"), project(F.col("s_nationkey")).alias("project"), F.sha2(name, 256).alias("fingerprint"), (k % 3 + 1).alias("level"), F.sha2(F.concat(name, k.cast("string")), 256).alias("digest"))
    manifests = s.where("s_acctbal > 1000").select(
        k.alias("release_id"), project(F.when(k % 5 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey"))).alias("project"),
        F.sha2(F.when(k % 7 == 0, F.concat(name, F.lit("x"))).otherwise(name), 256).alias("fingerprint"), F.when(k % 11 == 0, F.lit(9)).otherwise(k % 3 + 1).alias("level"), digest(13).alias("digest"),
    )
    return records, manifests, s.where("s_suppkey % 4 <> 1").select(k.alias("release_id"), digest(6).alias("digest"))


@query(f"WITH {_RECORDS_SQL} SELECT r.k AS release_id, CASE WHEN m.k IS NULL THEN 'no-manifest' WHEN m.project <> r.project THEN 'project-differs' WHEN m.fingerprint <> r.fingerprint THEN 'fingerprint-differs' WHEN m.level <> r.level THEN 'level-differs' WHEN m.digest <> r.digest THEN 'digest-differs' ELSE 'agrees' END AS manifest, CASE WHEN p.k IS NULL THEN 'no-plan' WHEN p.digest <> r.digest THEN 'digest-differs' ELSE 'agrees' END AS plan FROM records r LEFT JOIN manifests m ON m.k = r.k LEFT JOIN plans p ON p.k = r.k")
def manifest_agreement(spark, sf_dir):
    """Each record against its manifest and its plan; a missing one is told from an edited one."""
    return R.agreement(*_documents(spark, sf_dir))


_RULED_SQL = """CASE o_custkey % 4 WHEN 0 THEN 'rel-abc' WHEN 1 THEN 'REL 1' ELSE 'rel-' || translate(o_orderkey::VARCHAR, '0123456789', 'abcdefghij') END AS release_id, o_custkey % 7 AS sites, o_orderkey % 10 AS tag_bits, CASE o_custkey % 5 WHEN 0 THEN 'xyz' ELSE sha256(o_orderkey::VARCHAR) END AS fingerprint, CASE o_orderkey % 6 WHEN 0 THEN 'yesterday' ELSE '2024-01-02T03:04:05Z' END AS created_at"""


@query(f"SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT regexp_full_match(release_id, 'rel-[a-z2-7]{{1,32}}') THEN 'release-id' END, CASE WHEN sites < 1 THEN 'no-sites' END, CASE WHEN tag_bits < 2 OR tag_bits > 8 THEN 'tag-bits' END, CASE WHEN NOT regexp_full_match(fingerprint, '[0-9a-f]{{64}}') THEN 'fingerprint' END, CASE WHEN NOT regexp_full_match(created_at, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z') THEN 'created-at' END], lambda x: x IS NOT NULL), ',') AS broken FROM (SELECT o_orderkey, {_RULED_SQL} FROM orders)")
def record_violations(spark, sf_dir):
    """P20: the rules of a record that each of some made-up records breaks; none if it is valid."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(c % 4 == 0, "rel-abc").when(c % 4 == 1, "REL 1").otherwise(F.concat(F.lit("rel-"), F.translate(k.cast("string"), "0123456789", "abcdefghij"))).alias("release_id"),
        (c % 7).alias("sites"), (k % 10).alias("tag_bits"), F.when(c % 5 == 0, "xyz").otherwise(F.sha2(k.cast("string"), 256)).alias("fingerprint"), F.when(k % 6 == 0, "yesterday").otherwise("2024-01-02T03:04:05Z").alias("created_at"),
    )
    return rows.select("o_orderkey", F.array_join(R.broken(R.RECORD_RULES), ",").alias("broken"))


_OUTCOME_SQL = "SELECT CASE WHEN r >= 1 AND (m OR (p < 1e-3 AND r >= 2)) THEN 'PROVENANCE_DETECTED' WHEN r >= 1 OR part THEN 'INCONCLUSIVE' ELSE 'NO_PROVENANCE_DETECTED' END AS word FROM (SELECT o_custkey % 5 AS r, o_orderkey % 7 = 0 AS m, 0.5 * pow(10.0, -(o_orderkey % 5)) AS p, o_orderstatus = 'F' AS part FROM orders)"
_CODES_SQL = ", ".join(f"('{w}', {c})" for w, c in R.EXIT_CODES.items())


@query(f"SELECT c.word, c.code::INT AS code, count(o.word)::BIGINT AS n FROM (VALUES {_CODES_SQL}) c(word, code) LEFT JOIN ({_OUTCOME_SQL}) o ON o.word = c.word GROUP BY 1, 2")
def exit_codes(spark, sf_dir):
    """The table of codes of outcomes, verdicts and errors, and how often an outcome occurs."""
    codes = spark.createDataFrame(list(R.EXIT_CODES.items()), "word string, code int")
    df = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("r"), (F.col("o_orderkey") % 7 == 0).alias("m"), (0.5 * F.pow(F.lit(10.0), -(F.col("o_orderkey") % 5))).alias("p"), (F.col("o_orderstatus") == "F").alias("part"))
    words = df.groupBy(G.outcome(F.col("r"), G.clears_chance(F.col("r"), F.col("m"), F.col("p")), F.col("part")).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return codes.join(words, "word", "left").select("word", "code", F.coalesce("n", F.lit(0)).alias("n"))


# -- listings --------------------------------------------------------------------------------------

_REPORTS_SQL = "reports AS (SELECT user_id AS report, 'rel-' || strftime(ts, '%Y-%m-%d') AS release_id, count(*) AS n FROM events GROUP BY 1, 2), newest AS (SELECT max('rel-' || strftime(ts, '%Y-%m-%d')) AS id FROM events)"


def _reports(spark, sf_dir):
    """Reports on several releases each, and the newest release."""
    release = F.concat(F.lit("rel-"), F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("report"), release.alias("release_id")).agg(F.count(F.lit(1)).alias("n"))
    return rows, rows.agg(F.max("release_id").alias("id"))


@query(f"WITH {_REPORTS_SQL} SELECT report, count(*)::BIGINT AS releases FROM reports GROUP BY report HAVING bool_or(release_id = (SELECT id FROM newest))")
def reports_of_release(spark, sf_dir):
    """The reports that speak of one release, here the newest."""
    rows, newest = _reports(spark, sf_dir)
    marked = rows.join(F.broadcast(newest)).groupBy("report").agg(F.count(F.lit(1)).alias("releases"), F.bool_or(F.col("release_id") == F.col("id")).alias("has"))  # one row
    return marked.where("has").select("report", "releases")


@query(f"WITH {_REPORTS_SQL} SELECT report, lead FROM (SELECT report, arg_max(release_id, n * 100000000 + replace(substr(release_id, 5), '-', '')::BIGINT) AS lead FROM reports GROUP BY report) WHERE lead = (SELECT id FROM newest)")
def compliance_of_lead(spark, sf_dir):
    """The reports whose strongest release is the newest one."""
    rows, newest = _reports(spark, sf_dir)
    lead = rows.groupBy("report").agg(F.max_by("release_id", F.struct("n", "release_id")).alias("lead"))
    return lead.join(F.broadcast(newest), F.col("lead") == F.col("id")).select("report", "lead")


@query(f"WITH {_REPORTS_SQL} SELECT count(*)::BIGINT AS releases, sum(sites)::BIGINT AS sites FROM (SELECT release_id, sum(n) AS sites FROM reports GROUP BY 1)")
def releases_sum(spark, sf_dir):
    """The foot of the list of releases."""
    rows, _ = _reports(spark, sf_dir)
    return rows.groupBy("release_id").agg(F.sum("n").alias("sites")).agg(F.count(F.lit(1)).alias("releases"), F.sum("sites").alias("sites"))


@query("SELECT o_orderkey AS plan, count(*)::BIGINT AS listed, count_if(reason = 'dropped')::BIGINT AS dropped, count_if(reason <> 'dropped')::BIGINT AS refused, count_if(site IS NULL)::BIGINT AS empty FROM (SELECT o_orderkey, l.l_linenumber AS site, CASE WHEN l.l_returnflag = 'R' THEN 'dropped' WHEN l.l_returnflag = 'A' THEN 'overlapping-radius' ELSE 'identity-taken' END AS reason FROM orders LEFT JOIN lineitem l ON l.l_orderkey = o_orderkey) GROUP BY 1")
def plan_refusals(spark, sf_dir):
    """What a plan lists beside its sites: rows dropped and rows refused, put together; a plan without any stays."""
    lines = table(spark, sf_dir, "lineitem")
    dropped = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("plan"), F.lit("dropped").alias("reason"))
    why = F.when(F.col("l_returnflag") == "A", "overlapping-radius").otherwise("identity-taken")
    skipped = lines.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("plan"), why.alias("reason"))
    tally = dropped.unionByName(skipped).groupBy("plan").agg(F.count(F.lit(1)).alias("listed"), F.count_if(F.col("reason") == "dropped").alias("dropped"))
    plans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan")).join(tally, "plan", "left")
    none = F.col("listed").isNull()
    return plans.select("plan", F.coalesce("listed", F.lit(1)).alias("listed"), F.coalesce("dropped", F.lit(0)).alias("dropped"), F.coalesce(F.col("listed") - F.col("dropped"), F.lit(1)).alias("refused"), none.cast("long").alias("empty"))
