"""A project and its store: init, protect, verify, scan, and views of what was saved."""

from __future__ import annotations

import base64
import hashlib
import secrets
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.functions import keys as K
from tracelight.functions.signing import public_key
from tracelight.operators import detect as D
from tracelight.operators import embed as E
from tracelight.operators import grade as G
from tracelight.operators import rules
from tracelight.plans.text_queries import DEFAULT_EXCLUDES, EXTENSIONS
from tracelight.sources.archives import Limits, open_input, walk
from tracelight.sources.documents import Config, DocumentError, Store, canonical_json, is_signed, signed

#: Keys of a release set beside a scan that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 100_000


def _id(data: bytes, size: int = 10) -> str:
    return base64.b32encode(data[:size]).decode().lower().rstrip("=")


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: an ordered digest over paths and texts of a tree."""
    own = F.struct("file", F.sha2("text", 256).alias("h"))
    lines = F.transform(F.array_sort(F.collect_list(own)), lambda r: F.concat(F.lpad(F.length(r["file"]).cast("string"), 8, "0"), r["file"], r["h"]))
    return files.agg(F.sha2(F.array_join(lines, ""), 256).alias("fingerprint"))


class Session:
    """One project.  Secrets stay on the driver but for the derived keys that address sites."""

    def __init__(self, spark: SparkSession, store: Store):
        self.spark, self.store = spark, store

    # -- opening -----------------------------------------------------------------------------------

    @classmethod
    def init(cls, spark: SparkSession, root: str | Path, config: Config = Config(), secret: bytes | None = None) -> Session:
        store = Store.init(root, config)
        if not (store.path / "private" / "root.json").exists():
            store.write_secret(secret or K.random_bytes())
        return cls(spark, store)

    @classmethod
    def discover(cls, spark: SparkSession, start: str | Path) -> Session:
        return cls(spark, Store.discover(start))

    def _keys(self) -> dict:
        root = self.store.secret()
        project = "prj1-" + _id(K.derive(root, "project"), 10)
        key = lambda what: K.derive(root, what, project.encode())
        return {"project": project, "site": key("site"), "tag": key("tag"), "selection": key("selection"), "seed": key("signing")}

    def files(self, path: str | Path, limits: Limits = Limits(), excludes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
        opened = open_input(self.spark, str(path), limits)
        return walk(opened, [*DEFAULT_EXCLUDES, f"**/{Store.FOLDER}/**", f"{Store.FOLDER}/**", *excludes], EXTENSIONS, limits)

    # -- writing -----------------------------------------------------------------------------------

    def protect(self, out: str | Path | None = None, release_id: str | None = None, dry_run: bool = False) -> dict:
        """Writes codes into the literals of the targets; gives a summary without keyed values.

        The changed tree goes to ``out``, or back to where it was read.  Manifest and record are written
        before any source.
        """
        config, keys = self.store.config(), self._keys()
        release = release_id or "rel-" + _id(secrets.token_bytes(10))
        if release in self.store.releases():
            raise DocumentError(f"release {release} exists already")
        files, omissions = self.files(self.store.root, excludes=config.excludes)
        inside = F.lit(False)
        for t in config.targets:
            inside = inside | F.lit(t == ".") | F.col("file").startswith(t.rstrip("/") + "/")
        files = files.cache()
        omissions = omissions.unionByName(E.not_probed(files.where(inside), "sites"))
        candidates = E.usable(E.harvest(files.where(inside), keys["site"], keys["selection"]), config.tag_bits, config.embed_strings).cache()
        judged = E.choose(candidates, config.target_sites).cache()
        chosen = judged.where("reason is null").join(candidates, ["file", "start"])
        width, tag = config.tag_bits, keys["tag"]
        picked = chosen.withColumn("location", F.element_at("locations", F.col("primary") + 1)).withColumn("family", F.element_at("families", (F.pmod(F.xxhash64("priority"), F.size("families")) + 1).cast("int")))
        coded = picked.withColumn("code", K.fragment_tag(tag, F.unhex("location"), width))
        sites = E.rendered(coded, width).where("rendered is not null and octet_length(rendered) <= 240").cache()
        done, proven = E.apply(files, sites, keys["site"])
        done, rows = done.cache(), proven.orderBy("file", "start").collect()  # at most target_sites rows
        if not rows:
            raise DocumentError("no safe locations: " + ", ".join(f"{r['reason']} {r['count']}" for r in judged.groupBy("reason").count().collect()))
        manifest = {
            "schema": "manifest-1", "project_id": keys["project"], "release_id": release, "tag_bits": width, "signature": "",
            "sites": [{"site": i, "file": r["file"], "line": r["line"], "class": r["class"], "family": r["family"], "primary": r["primary"], "locations": list(r["locations"]), "original": r["original"], "rendered": r["rendered"], "code": r["code"]} for i, r in enumerate(rows)],
        }
        manifest = signed(manifest, keys["seed"])
        record = {
            "schema": "release-1", "project_id": keys["project"], "release_id": release, "created_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "fingerprint": fingerprint(done).first()["fingerprint"],
            "tag_bits": width, "sites": len(rows), "skipped": judged.where("reason is not null").count(), "manifest_digest": hashlib.sha256(canonical_json(manifest)).hexdigest(),
            "form_set": hashlib.sha256(",".join(sorted({r["family"] for r in rows})).encode()).hexdigest()[:16], "verify_key": base64.b64encode(public_key(keys["seed"])).decode(),
        }
        record = signed(record, keys["seed"])
        if not dry_run:
            self.store.write_release(release, manifest, record)
            touched = {r["file"] for r in rows}
            for r in done.where(F.col("file").isin(*touched) if out is None else F.lit(True)).toLocalIterator():
                Store._write(Path(out or self.store.root) / r["file"], r["text"].encode())
        summary = {"release_id": release, "sites": len(rows), "files": len({r["file"] for r in rows}), "families": sorted({r["family"] for r in rows}), "omitted": omissions.count(), "skipped": record["skipped"]}
        for df in (files, candidates, judged, sites, done):
            df.unpersist()
        return summary

    # -- reading -----------------------------------------------------------------------------------

    def _authentic(self, release_ids: list[str]) -> list[tuple[dict, dict]]:
        """Manifests and records, checked against each other and the project's key; newest first."""
        keys, out = self._keys(), []
        key = public_key(keys["seed"])
        for r in release_ids:
            manifest, record = self.store.manifest(r), self.store.record(r)
            if not is_signed(manifest, key) or not is_signed(record, key):
                raise DocumentError(f"release {r} was edited: its signature does not hold")
            if hashlib.sha256(canonical_json(manifest)).hexdigest() != record["manifest_digest"] or manifest["project_id"] != keys["project"]:
                raise DocumentError(f"release {r}: manifest and record disagree")
            out.append((manifest, record))
        return sorted(out, key=lambda x: (x[1]["created_at"], x[1]["release_id"]), reverse=True)

    def _sites(self, pairs: list[tuple[dict, dict]]) -> DataFrame:
        rows = [(m["release_id"], s["site"], s["file"], m["tag_bits"], s["family"], s["code"], s["rendered"], s["locations"]) for m, _ in pairs for s in m["sites"]]
        return self.spark.createDataFrame(rows, "release_id string, site int, file string, width int, family string, expected int, rendered string, locations array<string>")

    def detection(self, files: DataFrame, release_ids: list[str]) -> DataFrame:
        """One row for each site of the releases: its status in ``files``."""
        pairs = self._authentic(release_ids)
        sites, widths = self._sites(pairs), sorted({m["tag_bits"] for m, _ in pairs})
        hypotheses = E.hypotheses(files, self._keys()["site"])
        index = sites.select("release_id", "site", "width", "family", "rendered", F.posexplode("locations").alias("slot", "loc"))
        small = sum(len(m["sites"]) for m, _ in pairs) * 4 <= BROADCAST_KEYS
        asked = hypotheses.select("file", "start", "end", "tokens", "line", "text", F.posexplode("locations").alias("_", "loc")).drop("_")
        hits = asked.join(F.broadcast(index) if small else index, "loc")
        by = ["release_id", "site", "width", "family", "rendered", "file", "line", "text"]
        seen = hits.groupBy(*by).agg(F.min(F.struct("start", "end", "tokens")).alias("first"), F.array_sort(F.collect_set("slot")).alias("slots"))
        code = F.lit(None).cast("int")
        for w in widths:
            code = F.when(F.col("width") == w, E.read_code(F.col("text"), F.col("family"), w)).otherwise(code)
        seen = seen.withColumn("code", code).withColumn("exact", F.col("text") == F.col("rendered")).withColumn("seq", F.struct(F.col("first.tokens") > 1, "file", "first"))
        return D.site_status(sites, D.capped(seen.select("release_id", "site", "seq", "file", "exact", "code")))

    def scan(self, path: str | Path, release_ids: list[str] | None = None, limits: Limits = Limits(), save: str | None = None) -> dict:
        """The graded report of a candidate, strongest release first."""
        files, omissions = self.files(path, limits)
        files = files.cache()
        omissions = omissions.unionByName(E.not_probed(files)).cache()
        ids = release_ids or self.store.releases()
        status = self.detection(files, ids).cache()
        marks = {r["release_id"]: r["fingerprint"] for _, r in self._authentic(ids)}
        own = fingerprint(files).first()["fingerprint"]
        matched = F.col("release_id").isin([r for r, f in marks.items() if f == own] or [""])
        t = D.release_tally(status)
        t = t.withColumn("level_rank", G.level_rank(F.col("fragments"), F.col("files"), matched, F.col("probability"))).withColumn("fingerprint", F.when(matched, "match").otherwise("no-match"))
        partial = omissions.where("kind = 'not-examined'").limit(1).count() > 0
        verdict = G.outcome(F.col("level_rank"), G.clears_chance(F.col("level_rank"), matched, F.col("probability")), F.lit(partial))
        order = [F.desc("level_rank"), F.desc("fragments"), F.desc("bits"), F.desc("release_id")]
        rows = [r.asDict() for r in t.withColumn("level", G.level_word(F.col("level_rank"))).withColumn("outcome", verdict).orderBy(*order).collect()]  # one row a release
        evidence = [r.asDict() for r in status.where("rank > 0").orderBy(F.desc("rank"), "release_id", "site").select("release_id", "site", "status", "found_in", "probes").collect()]  # at most one row a site
        report = {
            "schema": "report-1", "candidate": Path(path).name, "outcome": rows[0]["outcome"], "level": rows[0]["level"], "partial": partial,
            "files": files.count(), "omissions": omissions.count(),
            "releases": [{k: (v if not isinstance(v, float) else f"{v:.9g}") for k, v in r.items()} for r in rows],
            "evidence": [{"id": f"EV-{i:03d}", **e} for i, e in enumerate(evidence)],
        }
        if save:
            report["saved"] = self.store.save_report(save, report)
        for df in (status, files, omissions):
            df.unpersist()
        return report

    def verify(self, release_id: str | None = None, path: str | Path | None = None) -> dict:
        """Whether one release still stands in the project's own tree."""
        chosen = release_id or self.release_history()[-1]["release_id"]
        files, omissions = self.files(path or self.store.root)
        omissions = omissions.unionByName(E.not_probed(files))
        status = self.detection(files, [chosen])
        t = status.agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("rank") >= 2).alias("confirmed"), F.count_if(F.col("rank") == 3).alias("exact"), F.count_if(F.col("rank") == 1).alias("stripped"), F.count_if(F.col("rank") == 0).alias("absent"))
        partial = omissions.where("kind = 'not-examined'").limit(1).count() > 0
        row = t.withColumn("verdict", G.verify_verdict(F.col("confirmed"), F.col("expected"), F.lit(partial))).first().asDict()
        return {"schema": "verify-1", "release_id": chosen, "partial": partial, **row}

    # -- views -------------------------------------------------------------------------------------

    def release_history(self) -> list[dict]:
        """Records without their signatures, oldest first."""
        rows = [self.store.record(r) for r in self.store.releases()]
        return [{k: v for k, v in r.items() if k != "signature"} for r in sorted(rows, key=lambda r: (r["created_at"], r["release_id"]))]

    def view(self, name: str) -> DataFrame:
        """One of the views ``store``, ``releases``, ``fragments``, ``families``, ``reports``, ``identity``, ``config``, ``omissions``."""
        spark = self.spark
        if name == "store":
            return spark.createDataFrame(self.store.inventory(), "path string, visibility string")
        if name == "releases":
            rows = [(r["release_id"], r["created_at"], r["sites"], r["tag_bits"], r["fingerprint"]) for r in self.release_history()]
            return spark.createDataFrame(rows, "release_id string, created_at string, sites int, tag_bits int, fingerprint string")
        if name in ("fragments", "families"):
            rows = [(m["release_id"], s["site"], s["file"], s["line"], s["class"], s["family"]) for m, _ in self._authentic(self.store.releases()) for s in m["sites"]]
            df = spark.createDataFrame(rows, "release_id string, site int, file string, line int, class string, family string")
            return df if name == "fragments" else df.groupBy("release_id", "class", "family").count()
        if name == "reports":
            return spark.createDataFrame([(n, *self._told(n)) for n in self.store.reports()], "name string, outcome string, level string, evidence int, fault string")
        if name == "identity":
            keys = self._keys()
            return spark.createDataFrame([(keys["project"], base64.b64encode(public_key(keys["seed"])).decode())], "project_id string, verify_key string")
        if name == "config":
            c = self.store.config()
            return spark.createDataFrame([(list(c.targets), c.target_sites, c.tag_bits, c.embed_strings)], "targets array<string>, target_sites int, tag_bits int, embed_strings boolean")
        if name == "omissions":
            return self.files(self.store.root)[1]
        raise DocumentError(f"no view {name}")

    def _told(self, name: str) -> tuple:
        """Outcome, level and evidence of a saved report; of one that cannot be read, what is wrong with it."""
        try:
            r = self.store.report(name)
            return r["outcome"], r["level"], len(r["evidence"]), None
        except (ValueError, KeyError, TypeError, OSError) as e:
            return None, None, None, f"{type(e).__name__}: {e}"

    def compliance(self, report: dict) -> dict:
        """How completely the strongest release of a report is covered."""
        lead = report["releases"][0] if report["releases"] else {"sites": 0, "fragments": 0}
        n, f = lead["sites"], lead["fragments"]
        full = not report["partial"] and report["outcome"] == "PROVENANCE_DETECTED"
        return {"schema": "compliance-1", "sites": n, "fragments": f, "grade": "NONE" if not n or not f else "PARTIAL" if f < n or not full else "FULL"}

    def badge(self, report: dict) -> dict:
        """A small public document that says what a report found."""
        return signed({"schema": "badge-1", "project_id": self._keys()["project"], "outcome": report["outcome"], "level": report["level"], "signature": ""}, self._keys()["seed"])

    def registry(self) -> dict:
        """The public list of releases, oldest first."""
        public = ("release_id", "created_at", "fingerprint", "sites", "verify_key")
        return {"schema": "registry-1", "releases": [{k: r[k] for k in public} for r in self.release_history()]}


def report_text(report: dict, most: int = 24) -> str:
    """A report for people."""
    lines = [f"{report['outcome']}  {report['level']}" + ("  (partial)" if report["partial"] else ""), f"{report['files']} files read, {report['omissions']} left out"]
    for r in report["releases"]:
        lines.append(f"  {r['release_id']}: {r['fragments']} of {r['sites']} fragments in {r['files']} files, fingerprint {r['fingerprint']}, {r['level']}")
    shown = report["evidence"][:most]
    lines += [f"  {e['id']} site {e['site']} {e['status']} in {e['found_in']}" for e in shown]
    if len(report["evidence"]) > len(shown):
        lines.append(f"  and {len(report['evidence']) - len(shown)} more")
    return "\n".join(lines)


EXIT_CODES = {k: v for k, v in rules.EXIT_CODES.items() if k.isupper()}
