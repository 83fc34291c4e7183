import json

import pytest

from samples import PROJECT
from tracelight import cli
from tracelight.sources.archives import write_tree
from tracelight.sources.documents import DocumentError


def test_commands(spark, tmp_path):
    write_tree(tmp_path, PROJECT)
    said = []

    def run(*words):
        said.clear()
        return cli.run(cli.parser().parse_args(["--project", str(tmp_path), *words]), spark, said.append)

    with pytest.raises(DocumentError):
        run("verify")
    assert run("init", "--sites", "8") == 0 and run("generate", "--release", "rel-x") == 0
    assert run("registry") == 0 and said == [""]
    assert run("protect", "--release", "rel-a") == 0 and run("pre-commit") == 0 and said[0].startswith("INTACT")
    assert run("scan", str(tmp_path), "--save", "one") == 1 and run("report") == 0 and said == ["one"]
    assert cli.run(cli.parser().parse_args(["--json", "--project", str(tmp_path), "report", "one"]), spark, said.append) == 0
    assert json.loads(said[-1])["level"] == "VERY_STRONG"
    for name in ("badge", "compliance"):
        assert run(name, "one") == 0 and json.loads(said[0])["schema"] == f"{name}-1"
    for view in cli.VIEWS:
        assert run("inspect", view) == 0


def test_words():
    assert cli.nearest("protcet") == "protect" and cli.nearest("zzzz") is None
    assert cli.main(["scna"]) == 2
