"""Text, paths, filters on files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelight.functions import text as T
from tracelight.operators import ranks
from tracelight.plans.registry import FILES_SQL, files, query, table

# The patterns of paths that are left out by default, store folder apart.
DEFAULT_EXCLUDES = [
    "**/node_modules/**",
    "**/.git/**",
    "**/target/**",
    "**/dist/**",
    "**/build/**",
    "**/.venv/**",
    "**/venv/**",
    "**/__pycache__/**",
    "**/vendor/**",
    "**/*.min.js",
    "**/*.min.css",
    "**/*.map",
]
# Extension, language, and how it is read.
EXTENSIONS = {"js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript", "py": "python", "pyi": "python"}
# Limits and the ceilings above which no configuration raises them.
LIMITS = {
    "max_file_bytes": (8 * 1024 * 1024, 64 * 1024 * 1024),
    "max_parse_bytes": (4 * 1024 * 1024, 32 * 1024 * 1024),
    "max_nodes_per_tree": (2_000_000, 8_000_000),
    "max_depth": (256, 512),
    "max_parse_millis": (2_000, 20_000),
    "max_files": (200_000, 1_000_000),
    "max_total_bytes": (8 * 1024**3, 64 * 1024**3),
    "max_sites_per_file": (4_000, 20_000),
    "max_archive_entries": (10_000, 100_000),
    "max_archive_member_bytes": (64 * 1024 * 1024, 256 * 1024 * 1024),
    "max_archive_expanded_bytes": (2 * 1024**3, 16 * 1024**3),
    "max_archive_ratio": (200, 1000),
    "max_archive_depth": (1, 2),
    "max_locations_per_manifest": (4_096, 16_384),
    "max_digest_set_entries": (4_000_000, 16_000_000),
    "max_shingles_per_region": (32_768, 262_144),
    "max_rendered_items": (400, 10_000),
}


@query("SELECT doc_id, length(regexp_replace(text, '\\r\\n?', chr(10), 'g'))::BIGINT AS n, md5(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS h FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN doc_id % 3 = 1 THEN replace(text, chr(10), chr(13)) ELSE text END AS text FROM documents)")
def newline_normalize(spark, sf_dir):
    """F2 on texts whose line ends were mixed up."""
    k, t = F.col("doc_id"), F.col("text")
    mixed = F.when(k % 3 == 0, F.replace(t, F.lit("\n"), F.lit("\r\n"))).when(k % 3 == 1, F.replace(t, F.lit("\n"), F.lit("\r"))).otherwise(t)
    out = T.newlines_to_lf(mixed)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(out).cast("long").alias("n"), F.md5(out).alias("h"))


@query("SELECT doc_id, CASE WHEN crlf > lf - crlf THEN 'crlf' ELSE 'lf' END AS newline, crlf::BIGINT AS crlf FROM (SELECT doc_id, (length(text) - length(replace(text, chr(13) || chr(10), ''))) / 2 AS crlf, length(text) - length(replace(text, chr(10), '')) AS lf FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS text FROM documents))")
def dominant_newline(spark, sf_dir):
    """the first line end of every other text is made CRLF."""
    first = F.concat(F.substring_index("text", "\n", 1), F.lit("\r\n"), F.expr("substring(text, instr(text, '\n') + 1)"))
    t = F.when((F.col("doc_id") % 2 == 0) & F.contains("text", F.lit("\n")), first).otherwise(F.col("text"))
    df = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return df.select("doc_id", T.dominant_newline(F.col("t")).alias("newline"), T.occurrences(F.col("t"), "\r\n").alias("crlf"))


@query("SELECT doc_id, length(nfc_normalize(text))::BIGINT AS n, md5(nfc_normalize(text)) AS h FROM (SELECT doc_id, replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)) AS text FROM documents)")
def nfc_normalize(spark, sf_dir):
    """F1 on texts whose accents were taken apart."""
    apart = F.replace(F.replace("text", F.lit("é"), F.lit("é")), F.lit("ü"), F.lit("ü"))
    out = table(spark, sf_dir, "documents").select("doc_id", T.nfc(apart).alias("t"))
    return out.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("h"))


@query("SELECT doc_id, doc_id % 4 <> 0 AS valid FROM documents")
def utf8_valid(spark, sf_dir):
    """every fourth text gets a byte that no UTF-8 text has."""
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.encode("text", "UTF-8"), F.lit(b"\xff"))).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.is_valid_utf8(raw.cast("string")).alias("valid"))


@query("SELECT doc_id, length(regexp_replace(t, '^\\x{FEFF}', ''))::BIGINT AS n FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(65279) || text ELSE text END AS t FROM documents)")
def strip_bom(spark, sf_dir):
    """F3."""
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("﻿"), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.strip_bom(t)).cast("long").alias("n"))


@query(f"WITH {FILES_SQL} SELECT doc_id, array_to_string(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda p: p NOT IN ('', '.')), '/') AS path FROM files")
def canonical_relpath(spark, sf_dir):
    """F6."""
    return files(spark, sf_dir).select("doc_id", T.canonical_relpath(F.col("path")).alias("path"))


@query(f"WITH {FILES_SQL} SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda p: p NOT IN ('', '.')), '/'), '^a/\\.\\./', '') AS path FROM files")
def lexical_normal(spark, sf_dir):
    """F8."""
    return files(spark, sf_dir).select("doc_id", T.lexical_normal(F.col("path")).alias("path"))


@query("SELECT event_id, CASE WHEN length(trim(p)) = 0 THEN 'empty' WHEN p LIKE '/%' THEN 'absolute' WHEN regexp_matches(p, '^[A-Za-z]:') THEN 'drive' WHEN list_contains(string_split(p, '/'), '..') THEN 'parent' END AS fault FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '/etc/x' WHEN 2 THEN 'C:/x' WHEN 3 THEN 'a/../../b' WHEN 4 THEN 'a..b/c' ELSE event_type || '/x' END AS p FROM events)")
def archive_member_fault(spark, sf_dir):
    """F9."""
    k = F.col("event_id") % 6
    p = F.when(k == 0, "").when(k == 1, "/etc/x").when(k == 2, "C:\\x").when(k == 3, "a/../../b").when(k == 4, "a..b/c").otherwise(F.concat("event_type", F.lit("/x")))
    return table(spark, sf_dir, "events").select("event_id", T.member_fault(p).alias("fault"))


@query(f"WITH {FILES_SQL} SELECT doc_id, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS ext, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) IN ('zip','tar','gz','tgz','bz2','xz','7z','jar','war','whl','vsix','apk','epub','nupkg') AS archive FROM files")
def archive_by_extension(spark, sf_dir):
    """F10."""
    p = F.col("path")
    return files(spark, sf_dir).select("doc_id", T.extension(p).alias("ext"), T.is_archive(p).alias("archive"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 59) || '…' ELSE text END AS clipped FROM documents")
def clip_text(spark, sf_dir):
    """F12."""
    return table(spark, sf_dir, "documents").select("doc_id", T.clip(F.col("text"), 60).alias("clipped"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 240 THEN left(text, (SELECT max(k) FROM range(60, 241) r(k) WHERE octet_length(encode(left(text, k))) <= 240)) || '…' ELSE text END AS hint FROM documents")
def byte_hint(spark, sf_dir):
    """F11."""
    return table(spark, sf_dir, "documents").select("doc_id", T.hint(F.col("text")).alias("hint"))


@query("SELECT event_id, replace(regexp_extract(p, '[^/\\\\]*$'), '.json', '') AS stem, regexp_matches(regexp_extract(p, '[^/\\\\]*$'), '^[A-Za-z0-9_-][A-Za-z0-9._-]{0,119}$') AS safe FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'reports/' WHEN 1 THEN 'a\\b\\' ELSE '' END || event_type || '-' || event_id || CASE WHEN event_id % 2 = 0 THEN '.json' ELSE ' x' END AS p FROM events)")
def report_stem(spark, sf_dir):
    """F14 and X16."""
    k = F.col("event_id")
    p = F.concat(F.when(k % 3 == 0, "reports/").when(k % 3 == 1, "a\\b\\").otherwise(""), "event_type", F.lit("-"), k.cast("string"), F.when(k % 2 == 0, ".json").otherwise(" x"))
    last = F.element_at(F.split(p, r"[/\\]"), -1)
    return table(spark, sf_dir, "events").select("event_id", T.report_stem(p).alias("stem"), T.safe_report_name(last).alias("safe"))


@query("SELECT p_partkey, c.name AS nearest, c.d::INT AS distance FROM (SELECT p_partkey, substr(w, 1 + p_partkey % 3) AS typed FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'protect' WHEN 1 THEN 'verify' WHEN 2 THEN 'inspect' ELSE 'report' END AS w FROM part)) t, LATERAL (SELECT name, levenshtein(t.typed, name) AS d FROM (VALUES ('badge'), ('inspect'), ('protect'), ('report'), ('scan'), ('verify')) v(name) WHERE levenshtein(t.typed, name) <= 2 ORDER BY d, name LIMIT 1) c")
def nearest_command(spark, sf_dir):
    """F16: the nearest of a few names, at most two edits away."""
    k = F.col("p_partkey")
    word = F.when(k % 4 == 0, "protect").when(k % 4 == 1, "verify").when(k % 4 == 2, "inspect").otherwise("report")
    typed = F.expr("substring(w, cast(1 + p_partkey % 3 as int))")
    names = F.array(*[F.lit(n) for n in ("badge", "inspect", "protect", "report", "scan", "verify")])
    best = F.array_min(F.transform(names, lambda n: F.struct(F.levenshtein(F.col("typed"), n).alias("d"), n.alias("name"))))
    df = table(spark, sf_dir, "part").select("p_partkey", word.alias("w")).withColumn("typed", typed).withColumn("b", best)
    return df.where("b.d <= 2").select("p_partkey", F.col("b.name").alias("nearest"), F.col("b.d").alias("distance"))


@query("SELECT doc_id, (length(left(text, (n_chars // 2)::INT)) - length(replace(left(text, (n_chars // 2)::INT), chr(10), '')) + 1)::BIGINT AS line FROM documents")
def line_starts(spark, sf_dir):
    """the line of the middle character."""
    half = F.expr("cast(n_chars div 2 as int)")
    return table(spark, sf_dir, "documents").select("doc_id", T.line_of(F.col("text"), half).alias("line"))


@query(f"WITH {FILES_SQL} SELECT doc_id, path LIKE 'node_modules/%' OR lower(path) LIKE '%.min.js' AS excluded FROM files")
def glob_excludes(spark, sf_dir):
    """F18, P1."""
    return files(spark, sf_dir).select("doc_id", T.excluded(F.col("path"), DEFAULT_EXCLUDES).alias("excluded"))


_ADMIT_SQL = f"""{FILES_SQL}, judged AS (
  SELECT doc_id, path, bytes, CASE
    WHEN path LIKE 'node_modules/%' OR lower(path) LIKE '%.min.js' THEN 'excluded'
    WHEN bytes = 0 THEN 'empty' WHEN bytes > 4000 THEN 'too-large'
    WHEN lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) IN ('zip','tar','gz','tgz','bz2','xz','7z','jar','war','whl','vsix','apk','epub','nupkg') THEN 'archive'
    WHEN lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) NOT IN ('js','mjs','cjs','jsx','ts','mts','cts','tsx','py','pyi') THEN 'no-adapter' END AS reason
  FROM files)"""


def judged(spark, sf_dir, largest: int = 4000):
    """Each file once, with the reason it is left out, or null."""
    p = F.col("path")
    reason = (
        F.when(T.excluded(p, DEFAULT_EXCLUDES), "excluded")
        .when(F.col("bytes") == 0, "empty")
        .when(F.col("bytes") > largest, "too-large")
        .when(T.is_archive(p), "archive")
        .when(~T.extension(p).isin(*EXTENSIONS), "no-adapter")
    )
    return files(spark, sf_dir).dropDuplicates(["path"]).select("doc_id", "path", "bytes", reason.alias("reason"))


@query(f"WITH {_ADMIT_SQL} SELECT doc_id, path, bytes::BIGINT AS bytes, reason FROM judged")
def admit_files(spark, sf_dir):
    """S5, P2, P3."""
    return judged(spark, sf_dir).withColumn("bytes", F.col("bytes").cast("long"))


@query(f"WITH {_ADMIT_SQL} SELECT reason, count(*)::BIGINT AS n, reason IN ('too-large', 'empty') AS not_examined FROM judged WHERE reason IS NOT NULL GROUP BY reason")
def omission_reasons(spark, sf_dir):
    """A6, and whether the reason makes an answer partial."""
    df = judged(spark, sf_dir).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return df.withColumn("not_examined", F.col("reason").isin("too-large", "empty"))


@query(f"WITH {_ADMIT_SQL} SELECT reason, first::BIGINT AS first_doc FROM (SELECT reason, min(doc_id) AS first FROM judged WHERE reason IS NOT NULL GROUP BY reason) ORDER BY first LIMIT 3")
def first_omission_reasons(spark, sf_dir):
    """The first three different reasons, in order."""
    df = judged(spark, sf_dir).where("reason is not null").groupBy("reason").agg(F.min("doc_id").alias("first_doc"))
    return df.orderBy("first_doc").limit(3)


@query(f"WITH {_ADMIT_SQL} SELECT CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' ELSE 'python' END AS language, count(*)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM judged WHERE reason IS NULL GROUP BY 1")
def language_totals(spark, sf_dir):
    """Admitted files and bytes by language, by a dimension join."""
    names = spark.createDataFrame(list(EXTENSIONS.items()), "ext string, language string")
    df = judged(spark, sf_dir).where("reason is null").withColumn("ext", T.extension(F.col("path")))
    return df.join(F.broadcast(names), "ext").groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").cast("long").alias("bytes"))


_LIMITS_SQL = ", ".join(f"('{k}', {v}, {c})" for k, (v, c) in LIMITS.items())


@query(f"SELECT name, least(asked, ceiling)::BIGINT AS granted, asked > ceiling AS violated FROM (SELECT name, value::BIGINT * f AS asked, ceiling::BIGINT AS ceiling FROM (VALUES {_LIMITS_SQL}) v(name, value, ceiling), (SELECT min(r_regionkey) + 6 AS f FROM region))")
def limit_clamp(spark, sf_dir):
    """Limits asked for at six times the default, lowered to the ceilings."""
    asked = spark.createDataFrame([(k, v, c) for k, (v, c) in LIMITS.items()], "name string, value long, ceiling long")
    factor = table(spark, sf_dir, "region").agg((F.min("r_regionkey") + 6).alias("f"))
    df = asked.crossJoin(F.broadcast(factor)).withColumn("asked", F.col("value") * F.col("f"))
    return df.select("name", F.least("asked", "ceiling").cast("long").alias("granted"), (F.col("asked") > F.col("ceiling")).alias("violated"))


@query("SELECT source, doc_id, total::BIGINT AS total, total > 100000 AS over FROM (SELECT source, doc_id, sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id) AS total FROM documents)")
def budget_running_total(spark, sf_dir):
    """Bytes read so far in each source, and whether the budget is gone."""
    df = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    df = ranks.running_sum(df, ["source"], F.expr("doc_id div 4096"), ["doc_id"], F.col("bytes"), "total")
    return df.select("source", "doc_id", "total", (F.col("total") > 100_000).alias("over"))


@query("SELECT o_orderkey, (o_custkey + 1)::BIGINT AS packed, (o_orderkey * 37)::BIGINT AS plain, (o_orderkey * 37) // (o_custkey + 1) > 200 AS bomb FROM orders")
def compression_ratio(spark, sf_dir):
    """P23."""
    plain, packed = (F.col("o_orderkey") * 37).alias("plain"), (F.col("o_custkey") + 1).alias("packed")
    return table(spark, sf_dir, "orders").select("o_orderkey", packed, plain).withColumn("bomb", F.expr("plain div packed > 200"))


@query("WITH t AS (SELECT CASE WHEN doc_id % 11 = 0 THEN '.' ELSE source END AS dir, count(*) AS n FROM documents GROUP BY 1), top AS (SELECT dir, n FROM t ORDER BY n DESC, dir LIMIT 4) SELECT dir, n::BIGINT AS n FROM top WHERE dir = '.' OR NOT EXISTS (SELECT 1 FROM top WHERE dir = '.')")
def target_directories(spark, sf_dir):
    """The four busiest directories, or the root alone if it is one of them."""
    dirs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 11 == 0, ".").otherwise(F.col("source")).alias("dir"))
    top = dirs.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dir").limit(4)
    rooted = top.agg(F.coalesce(F.bool_or(F.col("dir") == "."), F.lit(False)).alias("rooted"))
    return top.crossJoin(F.broadcast(rooted)).where("dir = '.' or not rooted").select("dir", "n")


def suggested_sites(files):
    """How many sites suit a tree of so many files."""
    step = F.when(files <= 3, 8).when(files <= 15, 12).when(files <= 60, 20).when(files <= 250, 32).otherwise(48)
    return F.greatest(F.least(step, F.greatest(files * 6, F.lit(8))), F.lit(8))


@query("SELECT n_nationkey, n::BIGINT AS files, greatest(least(CASE WHEN n <= 3 THEN 8 WHEN n <= 15 THEN 12 WHEN n <= 60 THEN 20 WHEN n <= 250 THEN 32 ELSE 48 END, greatest(n * 6, 8)), 8)::BIGINT AS sites FROM (SELECT c_nationkey AS n_nationkey, count(*) // 2 AS n FROM customer GROUP BY 1)")
def site_suggestion(spark, sf_dir):
    df = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.expr("count(1) div 2").alias("files"))
    return df.withColumn("sites", suggested_sites(F.col("files")).cast("long"))


@query("SELECT event_id, CASE WHEN p = '' THEN 'foreign' WHEN p NOT LIKE '.store%' THEN 'source' WHEN p LIKE '.store/private%' THEN 'private' WHEN p LIKE '.store/public%' THEN 'public' WHEN p = '.store/config.toml' THEN 'config' ELSE 'private' END AS class FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'src/a.js' WHEN 2 THEN '.store/private/x' WHEN 3 THEN '.store/public/y' WHEN 4 THEN '.store/config.toml' ELSE '.store/z' END AS p FROM events)")
def artifact_class(spark, sf_dir):
    """P21."""
    k = F.col("event_id") % 6
    raw = F.when(k == 0, "./").when(k == 1, "src//a.js").when(k == 2, ".store/private/x").when(k == 3, ".\\.store/public/y").when(k == 4, ".store/config.toml").otherwise(".store/z")
    return table(spark, sf_dir, "events").select("event_id", artifact_class_of(raw).alias("class"))


def artifact_class_of(path, store: str = ".store", config: str = "config.toml"):
    parts = F.filter(F.split(T.canonical_relpath(path), "/"), lambda p: p != "")
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    return (
        F.when(first.isNull(), "foreign").when(first != store, "source").when(second == "private", "private").when(second == "public", "public").when(second == config, "config").otherwise("private")
    )


@query("SELECT item_id, count(*)::BIGINT AS hits FROM benchmark b JOIN pages p ON contains(p.html, regexp_extract(b.text, '[A-Za-z]+')) GROUP BY item_id")
def needle_sweep(spark, sf_dir):
    """Pages that hold a needle; the needles, a bounded few, are broadcast."""
    needles = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract("text", "[A-Za-z]+", 0).alias("needle"))
    pages = table(spark, sf_dir, "pages").select("html")
    return pages.join(F.broadcast(needles), F.contains("html", F.col("needle"))).groupBy("item_id").agg(F.count(F.lit(1)).alias("hits"))


@query("SELECT source, round(median(n_chars), 3) AS median_chars FROM documents GROUP BY source")
def median_timing(spark, sf_dir):
    """A29, on text lengths."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.median("n_chars"), 3).alias("median_chars"))
