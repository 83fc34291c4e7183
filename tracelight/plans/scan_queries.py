"""Token streams, detection, grading and the views of a store."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelight.operators import detect as D
from tracelight.operators import grade as G
from tracelight.operators import lexical as X
from tracelight.plans.registry import query, table

# -- tokens ----------------------------------------------------------------------------------------

_TOKEN_SQL = X.TOKEN.replace("'", "''")
_TOKENS_SQL = f"""raw AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(text, '{_TOKEN_SQL}') AS ts FROM (SELECT conv_id, turn, text || ' f(x[3], "a" + ("b" + "c")) == 12 ; {{k: (7 * 6)}} -> 3.5' AS text FROM conversations)),
tokens AS (SELECT id, unnest(range(0, len(ts)))::INT AS pos, unnest(ts) AS token FROM raw),
kinds AS (SELECT id, pos, token, CASE WHEN regexp_matches(token, '^[A-Za-z_$\\x{{80}}-\\x{{10FFFF}}]') THEN 'word' WHEN regexp_matches(token, '^[0-9]') THEN 'number'
  WHEN length(token) > 1 AND (regexp_matches(token, '^".*"$') OR regexp_matches(token, '^''.*''$')) THEN 'string' WHEN regexp_matches(token, '^[+\\-*/%=<>!&|^~?]') THEN 'operator' ELSE 'punct' END AS kind FROM tokens)"""
_EXTRA = ' f(x[3], "a" + ("b" + "c")) == 12 ; {k: (7 * 6)} -> 3.5'


def _tokens(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat("text", F.lit(_EXTRA)).alias("text"))
    return X.tokens(df, "id")


@query(f"WITH {_TOKENS_SQL} SELECT id::BIGINT AS id, pos, token, kind FROM kinds")
def lexical_tokens(spark, sf_dir):
    """F67, F69."""
    return _tokens(spark, sf_dir)


@query(f"WITH {_TOKENS_SQL} SELECT kind, count(*)::BIGINT AS n, count(DISTINCT token)::BIGINT AS different FROM kinds GROUP BY kind")
def token_kind_counts(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("token").alias("different"))


@query(f"WITH {_TOKENS_SQL}, near AS (SELECT *, lag(token) OVER w AS b, lead(token) OVER w AS a FROM kinds WINDOW w AS (PARTITION BY id ORDER BY pos)) SELECT id::BIGINT AS id, pos, token, hazard FROM (SELECT *, CASE WHEN b IN ('.', '#') THEN 'member-or-directive' WHEN b IN ('[', '{{') AND a IN (']', '}}') THEN 'index' WHEN a = ':' THEN 'key' WHEN a IN ('.', '%') THEN 'part-of-a-larger-number' END AS hazard FROM near WHERE kind = 'number') WHERE hazard IS NOT NULL")
def number_hazards(spark, sf_dir):
    """P5, W5."""
    return X.number_hazards(_tokens(spark, sf_dir), "id")


@query(f"WITH {_TOKENS_SQL} SELECT id::BIGINT AS id, max(depth)::BIGINT AS deepest, arg_max(depth, pos)::BIGINT AS final FROM (SELECT id, pos, sum(CASE WHEN token IN ('(', '[', '{{') THEN 1 WHEN token IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS depth FROM kinds) GROUP BY id")
def bracket_depth(spark, sf_dir):
    """W4."""
    return X.bracket_depth(_tokens(spark, sf_dir), "id").groupBy("id").agg(F.max("depth").alias("deepest"), F.max_by("depth", "pos").alias("final"))


@query(f"WITH {_TOKENS_SQL}, m AS (SELECT id, pos, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS island FROM kinds WHERE kind <> 'word') SELECT id::BIGINT AS id, min(pos)::INT AS first, max(pos)::INT AS last, count(*)::BIGINT AS n FROM m GROUP BY id, island")
def material_runs(spark, sf_dir):
    """W3."""
    return X.material_runs(_tokens(spark, sf_dir), "id")


@query(f"""WITH {_TOKENS_SQL}, d AS (SELECT *, CASE WHEN token IN ('(', '[', '{{') THEN 1 WHEN token IN (')', ']', '}}') THEN -1 ELSE 0 END AS delta FROM kinds),
pairs AS (SELECT a.id, a.pos, b.pos - a.pos + 1 AS n FROM d a JOIN d b ON a.id = b.id AND b.pos BETWEEN a.pos + 1 AND a.pos + 5
  WHERE (a.kind IN ('number', 'string') OR a.token IN ('(', '[', '{{')) AND (b.kind IN ('number', 'string') OR b.token IN (')', ']', '}}'))),
walk AS (SELECT p.id, p.pos, p.n, c.kind, sum(c.delta) OVER (PARTITION BY p.id, p.pos, p.n ORDER BY c.pos) AS depth, c.pos - p.pos + 1 AS k FROM pairs p JOIN d c ON c.id = p.id AND c.pos BETWEEN p.pos AND p.pos + p.n - 1)
SELECT id::BIGINT AS id, pos, n::INT AS n FROM walk GROUP BY id, pos, n HAVING bool_and(kind <> 'word') AND min(depth) >= 0 AND max(CASE WHEN k = n THEN depth END) = 0""")
def form_windows(spark, sf_dir):
    """W2, P11, T10."""
    return X.form_windows(_tokens(spark, sf_dir), "id")


@query(f"WITH {_TOKENS_SQL}, f AS (SELECT id, token, min(pos) AS first FROM kinds WHERE kind = 'word' GROUP BY id, token) SELECT id::BIGINT AS id, token, first::INT AS first, (row_number() OVER (PARTITION BY id ORDER BY first) - 1)::INT AS number FROM f")
def rename_first_occurrence(spark, sf_dir):
    """W1."""
    return X.renamed_by_first_use(_tokens(spark, sf_dir), "id")


@query("SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(line, '" + _TOKEN_SQL + "'), lambda t: replace(replace(replace(replace(t, chr(92), chr(92) || chr(92)), ' ', '_'), '<', chr(92) || '<'), '>', chr(92) || '>')), ' ')) AS digest FROM (SELECT doc_id, text AS line FROM documents)")
def line_canonical_digest(spark, sf_dir):
    """F60, F61, F63 at level 1."""
    return X.canonical_texts(table(spark, sf_dir, "documents"), "doc_id", 1).select("doc_id", F.md5("canonical").alias("digest"))


@query(f"WITH {_TOKENS_SQL}, u AS (SELECT id, token, min(pos) AS first FROM kinds WHERE kind = 'word' GROUP BY id, token), r AS (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY first) - 1 AS number FROM u) SELECT k.id::BIGINT AS id, md5(string_agg(CASE WHEN k.kind = 'word' THEN '#l' || r.number WHEN k.kind = 'number' AND regexp_full_match(k.token, '0|[1-9][0-9]{{0,17}}') THEN '<n:' || k.token || '>' WHEN k.kind = 'number' AND regexp_full_match(k.token, '0[xX][0-9a-fA-F]{{1,15}}') THEN '<n:' || try_cast(lower(k.token) AS BIGINT) || '>' WHEN k.kind = 'string' AND NOT contains(k.token, chr(92)) THEN '<s:' || replace(replace(replace(replace(substr(k.token, 2, length(k.token) - 2), chr(92), chr(92) || chr(92)), ' ', '_'), '<', chr(92) || '<'), '>', chr(92) || '>') || '>' ELSE replace(replace(replace(replace(k.token, chr(92), chr(92) || chr(92)), ' ', '_'), '<', chr(92) || '<'), '>', chr(92) || '>') END, ' ' ORDER BY k.pos)) AS digest FROM kinds k LEFT JOIN r ON r.id = k.id AND r.token = k.token GROUP BY k.id")
def abstract_canonical_digest(spark, sf_dir):
    """F60, F66 at level 3: words by first use, literals by value."""
    df = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat("text", F.lit(_EXTRA)).alias("text"))
    return X.canonical_texts(df, "id", 3).select("id", F.md5("canonical").alias("digest"))


@query("SELECT doc_id, len(regexp_extract_all(t, '\\([0-9]+ [+*-] [0-9]+\\)'))::INT AS arithmetic, len(regexp_extract_all(t, '0x[0-9a-fA-F]+'))::INT AS hex FROM (SELECT doc_id, text || ' (12 + ' || doc_id || ') 0xAb' || doc_id || ' (3 / 4)' AS t FROM documents)")
def shape_locator(spark, sf_dir):
    """E10."""
    t = F.concat("text", F.lit(" (12 + "), F.col("doc_id").cast("string"), F.lit(") 0xAb"), F.col("doc_id").cast("string"), F.lit(" (3 / 4)"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.located_shapes(t, "arithmetic")).alias("arithmetic"), F.size(X.located_shapes(t, "mixed-hex")).alias("hex"))


# -- spans -----------------------------------------------------------------------------------------

_SPANS_SQL = "spans AS (SELECT l_orderkey AS file, l_linenumber AS line, (l_linenumber * 10)::INT AS s, (l_linenumber * 10 + 5 + l_suppkey % 30)::INT AS e FROM lineitem)"


def _spans(spark, sf_dir):
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), n.alias("line"), (n * 10).alias("s"), (n * 10 + 5 + F.col("l_suppkey") % 30).cast("int").alias("e"))


@query(f"WITH {_SPANS_SQL} SELECT file, point, line FROM (SELECT p.file, p.point, s.line, row_number() OVER (PARTITION BY p.file, p.point ORDER BY s.e - s.s, s.line) AS r FROM (SELECT DISTINCT l_orderkey AS file, (l_partkey % 60)::INT AS point FROM lineitem) p JOIN spans s ON s.file = p.file AND s.s <= p.point AND p.point < s.e) WHERE r = 1")
def enclosing_span(spark, sf_dir):
    """The tightest span around a point; the first of equals."""
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_partkey") % 60).cast("int").alias("point")).distinct()
    inside = points.join(_spans(spark, sf_dir), "file").where("s <= point and point < e")
    best = inside.groupBy("file", "point").agg(F.min(F.struct((F.col("e") - F.col("s")).alias("w"), "line")).alias("b"))
    return best.select("file", "point", F.col("b.line").alias("line"))


@query(f"WITH {_SPANS_SQL} SELECT a.file, count(*)::BIGINT AS overlaps FROM spans a JOIN spans b ON a.file = b.file AND a.line < b.line AND a.s < b.e AND b.s < a.e GROUP BY a.file")
def radii_overlap(spark, sf_dir):
    """Overlaps within a file; the spans of one file are few and meet on its key."""
    a = _spans(spark, sf_dir)
    b = a.select("file", F.col("line").alias("line_b"), F.col("s").alias("s_b"), F.col("e").alias("e_b"))
    return a.join(b, "file").where("line < line_b and s < e_b and s_b < e").groupBy("file").agg(F.count(F.lit(1)).alias("overlaps"))


@query(f"WITH {_SPANS_SQL} SELECT file, line, (coalesce(sum((e - s) % 7 - 3) OVER (PARTITION BY file ORDER BY line, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS shift FROM spans")
def edit_shifts(spark, sf_dir):
    """How far earlier edits have moved each span."""
    w = W.partitionBy("file").orderBy("line", "e").rowsBetween(W.unboundedPreceding, -1)
    return _spans(spark, sf_dir).select("file", "line", F.coalesce(F.sum((F.col("e") - F.col("s")) % 7 - 3).over(w), F.lit(0)).cast("long").alias("shift"))


# -- detection -------------------------------------------------------------------------------------

_SITES_SQL = "sites AS (SELECT 'rel-' || chr((97 + item_id % 4)::INT) AS release_id, item_id AS site, text, (item_id % 16)::INT AS expected, 4 AS width FROM benchmark)"
_FOUND_SQL = f"""{_SITES_SQL}, words AS (SELECT 's' AS side, site AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '') AS ws FROM sites UNION ALL
  SELECT 'd', doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '') FROM documents),
keys AS (SELECT DISTINCT side, id, array_to_string(ws[i:i + 7], ' ') AS key FROM (SELECT side, id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM words) WHERE len(ws) >= 8),
hits AS (SELECT s.id AS site, d.id AS doc_id, count(DISTINCT s.key) AS hits FROM keys s JOIN keys d ON s.key = d.key AND s.side = 's' AND d.side = 'd' GROUP BY 1, 2),
found AS (SELECT s.release_id, s.site, s.expected, s.width, h.doc_id, 'doc/' || h.doc_id AS file, h.hits, contains(d.text, s.text) AS exact, (h.doc_id % 16)::INT AS code FROM hits h JOIN sites s USING (site) JOIN documents d USING (doc_id))"""


def sites(spark, sf_dir):
    """The benchmark passages as four releases of sites, with made-up codes."""
    k = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("rel-"), F.char((97 + k % 4).cast("int"))).alias("release_id"), k.alias("site"), "text", (k % 16).cast("int").alias("expected"), F.lit(4).alias("width"), F.concat(F.lit("doc/"), (k * 7).cast("string")).alias("file"))


def candidates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"), "text")


def found(spark, sf_dir):
    """Observations of the sites in the documents, in the order of the documents."""
    seen = D.observations(candidates(spark, sf_dir), sites(spark, sf_dir))
    number = F.expr("cast(substring(file, 5) as bigint)")
    return seen.withColumn("seq", number).withColumn("code", (number % 16).cast("int"))


@query(f"WITH {_FOUND_SQL} SELECT release_id, site, file, hits::BIGINT AS hits, exact FROM found")
def scan_benchmark_in_documents(spark, sf_dir):
    """J1, U1."""
    return found(spark, sf_dir).select("release_id", "site", "file", "hits", "exact")


@query("SELECT item_id, count(*)::BIGINT AS documents FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def contains_benchmark(spark, sf_dir):
    """The documents that hold a passage word for word."""
    exact = found(spark, sf_dir).where("exact")
    return exact.groupBy(F.col("site").alias("item_id")).agg(F.count(F.lit(1)).alias("documents"))


_STATUS_SQL = f"""{_FOUND_SQL}, ranked AS (SELECT *, CASE WHEN exact THEN 3 WHEN code = expected THEN 2 ELSE 1 END AS rank, min(CASE WHEN exact THEN doc_id END) OVER (PARTITION BY release_id, site) AS stop FROM found),
read AS (SELECT * FROM ranked WHERE stop IS NULL OR doc_id <= stop),
best AS (SELECT release_id, site, max(rank) AS rank, arg_min(doc_id, -rank::BIGINT * 1000000000 + doc_id) AS place, max(CASE WHEN doc_id = site * 7 THEN rank END) AS home, count(*) AS probes, count(DISTINCT code) AS codes FROM read GROUP BY 1, 2),
status AS (SELECT s.release_id, s.site, s.width, coalesce(b.rank, 0) AS rank, CASE WHEN b.home = b.rank THEN 'doc/' || s.site * 7 WHEN b.rank IS NOT NULL THEN 'doc/' || b.place END AS found_in, coalesce(b.probes, 0) AS probes, CASE WHEN b.rank = 3 THEN b.probes ELSE coalesce(b.codes, 0) END AS codes, 'doc/' || s.site * 7 AS own FROM sites s LEFT JOIN best b USING (release_id, site))"""


def statuses(spark, sf_dir):
    return D.site_status(sites(spark, sf_dir), found(spark, sf_dir))


@query(f"WITH {_STATUS_SQL} SELECT release_id, site, ['absent', 'location-only', 'tag-confirmed', 'exact-rendering'][(rank + 1)::INT] AS status, found_in, probes::BIGINT AS probes, codes::BIGINT AS distinct_codes FROM status")
def site_status(spark, sf_dir):
    """J2, A10, A11."""
    return statuses(spark, sf_dir).select("release_id", "site", "status", "found_in", "probes", "distinct_codes")


_TALLY_SQL = f"""{_STATUS_SQL}, tally AS (SELECT release_id, count(*) AS sites, count_if(rank >= 2) AS fragments, count_if(rank = 3) AS exact, count_if(rank = 1) AS stripped, count_if(rank = 0) AS absent, count_if(rank >= 2 AND found_in <> own) AS moved, sum(CASE WHEN rank >= 2 THEN width ELSE 0 END) AS bits, count(DISTINCT CASE WHEN rank >= 2 THEN found_in END) AS files, sum(probes) AS probes, sum(CASE WHEN codes = 0 THEN 0 ELSE 1 - pow(1 - pow(0.5, width), codes) END) AS mean FROM status GROUP BY 1)"""


@query(f"WITH {_TALLY_SQL} SELECT release_id, sites::BIGINT AS sites, fragments::BIGINT AS fragments, exact::BIGINT AS exact, stripped::BIGINT AS stripped, absent::BIGINT AS absent, moved::BIGINT AS moved, bits::BIGINT AS bits, files::BIGINT AS files, probes::BIGINT AS probes, round(fragments / sites, 6) AS coverage FROM tally")
def release_tally(spark, sf_dir):
    """A7 to A9, A13, A14."""
    return D.release_tally(statuses(spark, sf_dir)).drop("mean", "probability")


@query(f"WITH {_TALLY_SQL} SELECT release_id, round(mean, 9) AS mean, round(probes * 0.0625::DOUBLE, 9) AS union_bound FROM tally")
def coincidence_lambda(spark, sf_dir):
    """A15, A16."""
    t = D.release_tally(statuses(spark, sf_dir))
    return t.select("release_id", F.round("mean", 9).alias("mean"), F.round(G.union_bound(F.col("probes"), 4), 9).alias("union_bound"))


_TAIL_SQL = "greatest(0, least(1, CASE WHEN n <= 0 THEN 1.0 WHEN m <= 0 THEN 0.0 ELSE 1 - exp(-m) * list_sum(list_transform(range(0, n), lambda i: pow(m, i) / gamma(i + 1))) END))"


@query(f"SELECT l_linenumber AS n, k, round({_TAIL_SQL}, 9) AS tail FROM (SELECT DISTINCT l_linenumber, l_linenumber::BIGINT AS n, (l_quantity / 10)::DOUBLE AS m, l_quantity AS k FROM lineitem)")
def poisson_tail(spark, sf_dir):
    """A17."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("k")).distinct()
    return df.select("n", "k", F.round(G.poisson_tail(F.col("k") / 10, F.col("n")), 9).alias("tail"))


_LADDER_SQL = "CASE WHEN f = 0 THEN 0 WHEN f >= 8 AND g >= 3 THEN 4 WHEN f >= 6 OR (f >= 4 AND g >= 2) THEN 3 WHEN f >= 2 THEN 2 ELSE 1 END"
_WORDS_SQL = "['NONE', 'WEAK', 'MODERATE', 'STRONG', 'VERY_STRONG']"


@query(f"SELECT o_orderkey, {_WORDS_SQL}[{_LADDER_SQL} + 1] AS by_count, {_WORDS_SQL}[least({_LADDER_SQL}, CASE WHEN p < 1e-8 THEN 4 WHEN p < 1e-5 THEN 3 WHEN p < 1e-3 THEN 2 ELSE 1 END) + 1] AS level FROM (SELECT o_orderkey, o_custkey % 11 AS f, o_orderkey % 5 AS g, 0.5 * pow(10.0, -(o_orderkey % 10)) AS p FROM orders)")
def ladder_level(spark, sf_dir):
    """G1, G2."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 11).alias("f"), (F.col("o_orderkey") % 5).alias("g"), (0.5 * F.pow(F.lit(10.0), -(F.col("o_orderkey") % 10))).alias("p"))
    return df.select("o_orderkey", G.level_word(G.ladder(F.col("f"), F.col("g"))).alias("by_count"), G.level_word(G.level_rank(F.col("f"), F.col("g"), F.lit(False), F.col("p"))).alias("level"))


@query("SELECT o_orderkey, CASE WHEN r >= 1 AND (m OR (p < 1e-3 AND r >= 2)) THEN 'PROVENANCE_DETECTED' WHEN r >= 1 OR part THEN 'INCONCLUSIVE' ELSE 'NO_PROVENANCE_DETECTED' END AS outcome FROM (SELECT o_orderkey, o_custkey % 5 AS r, o_orderkey % 7 = 0 AS m, 0.5 * pow(10.0, -(o_orderkey % 5)) AS p, o_orderstatus = 'F' AS part FROM orders)")
def outcome(spark, sf_dir):
    """G4, P16."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("r"), (F.col("o_orderkey") % 7 == 0).alias("m"), (0.5 * F.pow(F.lit(10.0), -(F.col("o_orderkey") % 5))).alias("p"), (F.col("o_orderstatus") == "F").alias("part"))
    return df.select("o_orderkey", G.outcome(F.col("r"), G.clears_chance(F.col("r"), F.col("m"), F.col("p")), F.col("part")).alias("outcome"))


@query("SELECT o_orderkey, CASE WHEN t = 0 THEN 'NONE' WHEN c * 3 >= t * 2 THEN 'STRONG' WHEN c * 3 >= t THEN 'MODERATE' ELSE 'WEAK' END AS level FROM (SELECT o_orderkey, o_custkey % 13 AS t, least(o_orderkey % 13, o_custkey % 13) AS c FROM orders)")
def partial_level(spark, sf_dir):
    """G3."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 13).alias("t"), F.least(F.col("o_orderkey") % 13, F.col("o_custkey") % 13).alias("c"))
    return df.select("o_orderkey", G.partial_level(F.col("c"), F.col("t")).alias("level"))


@query(f"WITH {_STATUS_SQL} SELECT release_id, count(*)::BIGINT AS expected, count_if(rank >= 2)::BIGINT AS confirmed, CASE WHEN count(*) = count_if(rank >= 2) THEN 'INTACT' WHEN release_id = 'rel-b' THEN 'INCONCLUSIVE' ELSE 'INCOMPLETE' END AS verdict FROM status GROUP BY release_id")
def verify_verdict(spark, sf_dir):
    """G9, A25; one release counts as read in part."""
    t = statuses(spark, sf_dir).groupBy("release_id").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("rank") >= 2).alias("confirmed"))
    return t.withColumn("verdict", G.verify_verdict(F.col("confirmed"), F.col("expected"), F.col("release_id") == "rel-b"))


@query(f"WITH {_TALLY_SQL} SELECT release_id, CASE WHEN sites = 0 OR fragments = 0 THEN 'NONE' WHEN fragments < sites THEN 'PARTIAL' WHEN files > 1 THEN 'FULL' ELSE 'PARTIAL' END AS grade FROM tally")
def compliance_grade(spark, sf_dir):
    """G10, A26."""
    t = D.release_tally(statuses(spark, sf_dir))
    return t.select("release_id", G.compliance_grade(F.col("sites"), F.col("fragments"), F.lit(True), F.col("files") > 1).alias("grade"))


@query(f"WITH {_STATUS_SQL}, kinds(kind, r) AS (VALUES ('absent', 0), ('location-only', 1), ('tag-confirmed', 2), ('exact-rendering', 3)) SELECT kind, count(s.rank)::BIGINT AS n FROM kinds LEFT JOIN status s ON s.rank = kinds.r GROUP BY kind")
def evidence_kind_histogram(spark, sf_dir):
    """Kinds without evidence are counted too."""
    kinds = spark.createDataFrame([(s,) for s in G.STATUSES], "kind string")
    counts = statuses(spark, sf_dir).groupBy(F.col("status").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {_STATUS_SQL} SELECT 'EV-' || lpad((row_number() OVER (PARTITION BY release_id ORDER BY rank DESC, site) - 1)::VARCHAR, 3, '0') AS id, release_id, site FROM status WHERE rank > 0")
def evidence_numbering(spark, sf_dir):
    """Numbered from 0, strongest first, within a release."""
    w = W.partitionBy("release_id").orderBy(F.desc("rank"), "site")
    number = F.lpad((F.row_number().over(w) - 1).cast("string"), 3, "0")
    return statuses(spark, sf_dir).where("rank > 0").select(F.concat(F.lit("EV-"), number).alias("id"), "release_id", "site")


@query(f"WITH {_FOUND_SQL}, n AS (SELECT release_id, site, doc_id, exact, row_number() OVER (PARTITION BY release_id, site ORDER BY doc_id) AS r FROM found), c AS (SELECT *, sum(CASE WHEN exact THEN 0 ELSE 1 END) OVER (PARTITION BY release_id, site ORDER BY doc_id) AS plain, sum(CASE WHEN r > 2 AND exact THEN 1 ELSE 0 END) OVER (PARTITION BY release_id, site) AS late, sum(CASE WHEN r > 2 AND exact THEN 1 ELSE 0 END) OVER (PARTITION BY release_id, site ORDER BY doc_id) AS late_rank, sum(CASE WHEN r <= 2 AND NOT exact THEN 1 ELSE 0 END) OVER (PARTITION BY release_id, site) AS room FROM n) SELECT release_id, site, doc_id AS seq, exact FROM c WHERE (r <= 2 AND (exact OR plain > late)) OR (r > 2 AND exact AND late_rank <= room)")
def observation_cap(spark, sf_dir):
    """W10, with a cap of two."""
    return D.capped(found(spark, sf_dir), 2).select("release_id", "site", "seq", "exact")


@query(f"WITH {_STATUS_SQL} SELECT release_id, site, found_in FROM status WHERE rank >= 2 AND found_in <> own")
def moved_sites(spark, sf_dir):
    """P15."""
    return statuses(spark, sf_dir).where("rank >= 2 and found_in <> own_file").select("release_id", "site", "found_in")


@query(f"WITH {_TALLY_SQL} SELECT release_id, fragments::BIGINT AS fragments, rank::INT AS place FROM (SELECT *, row_number() OVER (ORDER BY fragments DESC, bits DESC, release_id DESC) AS rank FROM tally)")
def best_release(spark, sf_dir):
    """Releases, strongest first; one row a release."""
    w = W.orderBy(F.desc("fragments"), F.desc("bits"), F.desc("release_id"))
    return D.release_tally(statuses(spark, sf_dir)).select("release_id", "fragments", F.row_number().over(w).alias("place"))


@query(f"WITH {_TALLY_SQL}, g AS (SELECT *, {_TAIL_SQL.replace('n <= 0', 'fragments <= 0').replace('range(0, n)', 'range(0, fragments::BIGINT)').replace('m <= 0', 'mean <= 0').replace('exp(-m)', 'exp(-mean)').replace('pow(m, i)', 'pow(mean, i)')} AS p FROM tally), l AS (SELECT *, least({_LADDER_SQL.replace('f >=', 'fragments >=').replace('f = 0', 'fragments = 0').replace('g >=', 'files >=')}, CASE WHEN p < 1e-8 THEN 4 WHEN p < 1e-5 THEN 3 WHEN p < 1e-3 THEN 2 ELSE 1 END) AS r FROM g) SELECT release_id, sites::BIGINT AS sites, fragments::BIGINT AS fragments, files::BIGINT AS files, round(mean, 9) AS mean, {_WORDS_SQL}[(r + 1)::INT] AS level, CASE WHEN r >= 1 AND p < 1e-3 AND r >= 2 THEN 'PROVENANCE_DETECTED' WHEN r >= 1 THEN 'INCONCLUSIVE' ELSE 'NO_PROVENANCE_DETECTED' END AS outcome FROM l")
def scan_report(spark, sf_dir):
    """The flagship: documents scanned for four releases, counted and graded."""
    g = D.graded(D.release_tally(statuses(spark, sf_dir)))
    return g.select("release_id", "sites", "fragments", "files", F.round("mean", 9).alias("mean"), "level", "outcome")


@query("WITH o AS (SELECT n_nationkey AS own, n_regionkey AS r FROM nation) SELECT a.own AS owner, b.own AS tree, a.r = b.r AS same FROM o a, o b")
def foreign_matrix(spark, sf_dir):
    """Every owner against every tree; 25 rows a side, as the table is fixed."""
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("owner"), F.col("n_regionkey").alias("ra"))
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tree"), F.col("n_regionkey").alias("rb"))
    return a.crossJoin(F.broadcast(b)).select("owner", "tree", (F.col("ra") == F.col("rb")).alias("same"))


@query("SELECT md5(text) AS loc FROM documents WHERE source < 'src15' INTERSECT SELECT md5(text) FROM documents WHERE source >= 'src15'")
def constellation_disjoint(spark, sf_dir):
    """U8: locations that two trees share."""
    df = table(spark, sf_dir, "documents").select("source", F.md5("text").alias("loc"))
    return df.where("source < 'src15'").select("loc").intersect(df.where("source >= 'src15'").select("loc"))


@query("WITH a AS (SELECT l_suppkey % 40 AS shape FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_partkey % 40 AS shape FROM lineitem WHERE l_returnflag <> 'A'), bag AS (SELECT * FROM a INTERSECT ALL SELECT * FROM b) SELECT shape, count(*)::BIGINT AS found FROM bag GROUP BY shape")
def shape_recall_bag(spark, sf_dir):
    """A bag intersection by counts, so no row is multiplied."""
    df = table(spark, sf_dir, "lineitem")
    a = df.where("l_returnflag = 'A'").groupBy((F.col("l_suppkey") % 40).alias("shape")).agg(F.count(F.lit(1)).alias("na"))
    b = df.where("l_returnflag <> 'A'").groupBy((F.col("l_partkey") % 40).alias("shape")).agg(F.count(F.lit(1)).alias("nb"))
    return a.join(b, "shape").select("shape", F.least("na", "nb").alias("found"))


# -- history and store -----------------------------------------------------------------------------

_HISTORY_SQL = "history AS (SELECT 'rel-' || strftime(ts, '%Y-%m-%d') AS release_id, min(ts) AS created_at, count(*) AS sites FROM events GROUP BY 1)"


def _history(spark, sf_dir):
    t = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy(F.concat(F.lit("rel-"), F.date_format(t, "yyyy-MM-dd")).alias("release_id")).agg(F.min(t).alias("created_at"), F.count(F.lit(1)).alias("sites"))


@query(f"WITH {_HISTORY_SQL} SELECT release_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, sites::BIGINT AS sites, row_number() OVER (ORDER BY created_at, release_id)::INT AS place FROM history")
def release_history(spark, sf_dir):
    """Oldest first; one row a release."""
    w = W.orderBy("created_at", "release_id")
    return _history(spark, sf_dir).select("release_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), "sites", F.row_number().over(w).alias("place"))


@query(f"WITH {_HISTORY_SQL} SELECT arg_max(release_id, created_at) AS release_id, count(*)::BIGINT AS releases FROM history")
def newest_release(spark, sf_dir):
    """W13, X6."""
    return _history(spark, sf_dir).agg(F.max_by("release_id", F.struct("created_at", "release_id")).alias("release_id"), F.count(F.lit(1)).alias("releases"))


@query("SELECT event_id, stem || CASE WHEN r > 1 THEN '-' || r ELSE '' END AS name FROM (SELECT event_id, stem, row_number() OVER (PARTITION BY stem ORDER BY event_id) AS r FROM (SELECT event_id, event_type || '-' || user_id % 50 AS stem FROM events))")
def save_collision_names(spark, sf_dir):
    """K4: a number behind names that are taken."""
    df = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit("-"), (F.col("user_id") % 50).cast("string")).alias("stem"))
    r = F.row_number().over(W.partitionBy("stem").orderBy("event_id"))
    return df.withColumn("r", r).select("event_id", F.when(F.col("r") > 1, F.concat("stem", F.lit("-"), F.col("r").cast("string"))).otherwise(F.col("stem")).alias("name"))


@query("SELECT 'private' AS visibility, 'manifest-' || s_suppkey AS name FROM supplier UNION ALL SELECT 'public', 'record-' || s_suppkey FROM supplier UNION ALL SELECT 'public', 'report-' || n_name FROM nation")
def store_inventory(spark, sf_dir):
    """Listings of a store put together, with who may see them."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    row = lambda df, v, p, c: df.select(F.lit(v).alias("visibility"), F.concat(F.lit(p), F.col(c).cast("string")).alias("name"))
    return row(s, "private", "manifest-", "s_suppkey").unionByName(row(s, "public", "record-", "s_suppkey")).unionByName(row(n, "public", "report-", "n_name"))


@query("SELECT o_orderpriority AS class, NULL AS family, count(*)::BIGINT AS n FROM orders GROUP BY 1 UNION ALL SELECT NULL, o_orderstatus, count(*)::BIGINT FROM orders GROUP BY 2")
def planned_site_tallies(spark, sf_dir):
    """Two tallies in one pass, by grouping sets."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("tl_orders")
    return spark.sql("SELECT o_orderpriority AS class, o_orderstatus AS family, count(*) AS n FROM tl_orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus))")


@query("SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.h, o.h) AS digest FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE lang <> 'fr') o FULL JOIN (SELECT doc_id, md5('new' || text) AS h FROM documents WHERE lang <> 'de') n ON n.doc_id = o.doc_id")
def overlay_digests(spark, sf_dir):
    """New digests over old ones."""
    df = table(spark, sf_dir, "documents")
    old = df.where("lang <> 'fr'").select("doc_id", F.md5("text").alias("old"))
    new = df.where("lang <> 'de'").select("doc_id", F.md5(F.concat(F.lit("new"), "text")).alias("new"))
    return old.join(new, "doc_id", "full").select("doc_id", F.coalesce("new", "old").alias("digest"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def untouched_files(spark, sf_dir):
    """Rows without a partner."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def bound_names(spark, sf_dir):
    """Rows with a partner."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(good, "doc_id", "left_semi")


@query("SELECT conv_id, count(*)::BIGINT AS turns, string_agg(role, '>' ORDER BY turn) AS roles, arg_min(text, turn) AS opening FROM conversations GROUP BY conv_id")
def ordered_fold(spark, sf_dir):
    """An ordered fold over a group."""
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"]), ">")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), roles.alias("roles"), F.min_by("text", "turn").alias("opening"))
