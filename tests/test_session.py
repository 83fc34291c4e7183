import gzip
import io
import json
import tarfile
import zipfile

import pytest

from samples import PROJECT, UNRELATED
from tracelight.operators import transforms as X
from tracelight.plans.session import EXIT_CODES, Session, report_text
from tracelight.plans.text_queries import DEFAULT_EXCLUDES, EXTENSIONS
from tracelight.sources.archives import Limits, open_input, read_tree, walk, write_tree
from tracelight.sources.documents import Config, DocumentError, Store

SECRET = bytes(range(32))


@pytest.fixture(scope="module")
def protected(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    write_tree(root, PROJECT)
    session = Session.init(spark, root, Config(target_sites=16, tag_bits=4), SECRET)
    session.summary = session.protect(release_id="rel-a")
    return session


def test_protect_writes_and_the_code_still_runs(protected):
    tree = read_tree(protected.store.root)
    assert protected.summary["sites"] >= 8 and protected.summary["files"] == 3
    assert any(tree[f] != PROJECT[f] for f in PROJECT)
    before, after = {}, {}
    exec(PROJECT["src/palette.py"], before)
    exec(tree["src/palette.py"], after)
    assert before["blend"](3, 4) == after["blend"](3, 4) and before["render"](5) == after["render"](5)
    assert before["Palette"]().pick(7) == after["Palette"]().pick(7)


def test_intact_copy(protected):
    report = protected.scan(protected.store.root)
    lead = report["releases"][0]
    assert report["outcome"] == "PROVENANCE_DETECTED" and report["level"] == "VERY_STRONG"
    assert lead["fragments"] == lead["sites"] == lead["exact"] and lead["fingerprint"] == "match"
    assert not report["partial"] and len(report["evidence"]) == lead["sites"]
    assert protected.verify("rel-a")["verdict"] == "INTACT"
    assert protected.compliance(report)["grade"] == "FULL"
    assert "PROVENANCE_DETECTED" in report_text(report) and EXIT_CODES[report["outcome"]] == 1


def test_unrelated_and_unprotected_trees(protected, tmp_path):
    write_tree(tmp_path / "other", UNRELATED)
    report = protected.scan(tmp_path / "other")
    assert report["releases"][0]["exact"] == 0 and report["outcome"] != "PROVENANCE_DETECTED"
    write_tree(tmp_path / "original", PROJECT)  # the code without the marks
    plain = protected.scan(tmp_path / "original")
    assert plain["releases"][0]["exact"] == 0 and plain["releases"][0]["stripped"] > 0


def _copied(spark, protected, name, sites=None):
    files, _ = protected.files(protected.store.root)
    return files, X.apply(files, name, sites)


@pytest.mark.parametrize("name", sorted(X.TRANSFORMS))
def test_refactorings_never_add_confirmations(spark, protected, name):
    files, after = _copied(spark, protected, name)
    status = protected.detection(after, ["rel-a"])
    kept = status.where("rank >= 2").count()
    assert 0 <= kept <= protected.summary["sites"]
    if name in ("variable_rename", "class_rename", "comment_removal", "file_movement", "function_rename"):
        assert kept >= protected.summary["sites"] // 2
    if name in ("comment_removal", "file_movement", "formatting", "constant_rewrite", "import_changes"):
        assert X.changed(files, after) > 0


def test_removed_marks(spark, protected):
    sites = protected._sites(protected._authentic(["rel-a"]))
    own = {s["rendered"]: s["original"] for s in protected.store.manifest("rel-a")["sites"]}
    pairs = spark.createDataFrame([(s["file"], s["rendered"], own[s["rendered"]]) for s in protected.store.manifest("rel-a")["sites"]], "file string, rendered string, original string")
    _, bare = _copied(spark, protected, "artifact_removal", pairs)
    assert protected.detection(bare, ["rel-a"]).where("rank >= 2").count() == 0
    assert sites.count() == len(own)


def test_half_a_copy_confirms_no_more(spark, protected):
    files, _ = protected.files(protected.store.root)
    half = X.fraction(files, 1, 2)
    assert half.count() == 2
    kept = protected.detection(half, ["rel-a"]).where("rank >= 2").count()
    assert 0 < kept < protected.summary["sites"]


def test_archives(spark, protected, tmp_path):
    tree = {k: v for k, v in read_tree(protected.store.root).items() if k.startswith("src/")}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in tree.items():
            info = zipfile.ZipInfo(k)
            info.external_attr = 0o100644 << 16
            z.writestr(info, v)
        z.writestr(zipfile.ZipInfo("inner.zip"), b"x")
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for k, v in tree.items():
            info = tarfile.TarInfo(k)
            info.size = len(v.encode())
            t.addfile(info, io.BytesIO(v.encode()))
    (tmp_path / "b.tar").write_bytes(raw.getvalue())
    (tmp_path / "c.tar.gz").write_bytes(gzip.compress(raw.getvalue()))
    for name in ("a.zip", "b.tar", "c.tar.gz"):
        report = protected.scan(tmp_path / name)
        assert report["releases"][0]["fragments"] == protected.summary["sites"], name
    assert protected.scan(tmp_path / "a.zip")["partial"]  # a nested archive was not opened
    (tmp_path / "palette.py.gz").write_bytes(gzip.compress(tree["src/palette.py"].encode()))
    assert protected.scan(tmp_path / "palette.py.gz")["releases"][0]["fragments"] > 0


def test_limits_never_read_as_clean(spark, protected, tmp_path):
    with zipfile.ZipFile(tmp_path / "bomb.zip", "w", zipfile.ZIP_DEFLATED) as z:
        info = zipfile.ZipInfo("a.py")
        info.external_attr = 0o100644 << 16
        z.writestr(info, b" " * 5_000_000, zipfile.ZIP_DEFLATED)
    bad = zipfile.ZipInfo("../a.py")
    bad.external_attr = 0o100644 << 16
    with zipfile.ZipFile(tmp_path / "up.zip", "w") as z:
        z.writestr(bad, "x")
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 and nothing more")
    for name in ("bomb.zip", "up.zip", "broken.zip"):
        files, omitted = walk(open_input(spark, str(tmp_path / name)), DEFAULT_EXCLUDES, EXTENSIONS)
        assert files.count() == 0 and [r.kind for r in omitted.collect()] == ["not-examined"], name
    report = protected.scan(tmp_path / "bomb.zip")
    assert report["outcome"] == "INCONCLUSIVE"
    write_tree(tmp_path / "big", {"a.py": "x = 1\n" * 2000, "b.bin": "q", "node_modules/c.js": "1"})
    files, omitted = walk(open_input(spark, str(tmp_path / "big")), DEFAULT_EXCLUDES, EXTENSIONS, Limits(file_bytes=100))
    assert {r.file: r.reason for r in omitted.collect()} == {"a.py": "too-large", "b.bin": "no-adapter", "node_modules/c.js": "excluded"}


def test_store_views_and_documents(spark, protected, tmp_path):
    assert Session.discover(spark, protected.store.root / "src").store.root == protected.store.root.resolve()
    report = protected.scan(protected.store.root, save="first")
    again = protected.scan(protected.store.root, save="first")
    assert (report["saved"], again["saved"]) == ("first", "first-2") and protected.store.reports() == ["first-2", "first"]
    assert protected.store.report("x/first.json")["level"] == "VERY_STRONG"
    for name in ("store", "releases", "fragments", "families", "reports", "identity", "config", "omissions"):
        assert protected.view(name).count() > 0 or name == "omissions"
    with pytest.raises(DocumentError):
        protected.view("nothing")
    with pytest.raises(DocumentError):
        protected.protect(release_id="rel-a")
    assert protected.badge(report)["signature"] and [r["release_id"] for r in protected.registry()["releases"]] == ["rel-a"]
    public = (protected.store.path / "public").rglob("*.json")
    text = "".join(p.read_text() for p in public)
    assert not any(n.decode("latin1") in text for n in X.encodings(SECRET))


def test_an_edited_manifest_is_refused(spark, tmp_path):
    write_tree(tmp_path, PROJECT)
    session = Session.init(spark, tmp_path, Config(target_sites=8), SECRET)
    session.protect(release_id="rel-b")
    path = session.store.path / "private" / "manifests" / "rel-b.json"
    value = json.loads(path.read_text())
    value["sites"][0]["code"] ^= 1
    path.write_text(json.dumps(value))
    with pytest.raises(DocumentError):
        session.scan(tmp_path)


def test_configs():
    assert Config.parse(Config(targets=("a", "b"), tag_bits=6).toml()) == Config(targets=("a", "b"), tag_bits=6)
    for bad in ("[protect]\ntag_bits = 1", "[protect]\nother = 1", "[more]\n", '[protect]\ntargets = ["../x"]'):
        with pytest.raises(DocumentError):
            Config.parse(bad)
    with pytest.raises(DocumentError):
        Store.discover("/")


def test_a_file_with_too_many_windows_makes_an_answer_partial(protected, tmp_path):
    tree = read_tree(protected.store.root)
    write_tree(tmp_path / "copy", {f: t for f, t in tree.items() if f in PROJECT})
    assert not protected.verify("rel-a", tmp_path / "copy")["partial"]
    write_tree(tmp_path / "copy", {"src/data.js": "const t = [" + "1, " * 11_000 + "9];\n"})
    report = protected.scan(tmp_path / "copy")
    assert report["partial"] and report["omissions"] >= 1 and protected.verify("rel-a", tmp_path / "copy")["partial"]
    assert report["releases"][0]["fragments"] == report["releases"][0]["sites"]
