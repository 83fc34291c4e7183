"""Shapes of cost and of selection on made-up trees."""

import time

from tracelight.functions import keys as K
from tracelight.operators import embed as E
from tracelight.sources.synthetic import synthetic_tree

KEY = K.derive(bytes(32), "site", b"test")


def test_trees_are_reproducible(spark):
    a, b = (synthetic_tree(spark, 5, 3).orderBy("file").collect() for _ in range(2))
    assert a == b and a != synthetic_tree(spark, 5, 4).orderBy("file").collect()
    assert len({r.text for r in a}) == 5


def test_cost_per_file_does_not_grow(spark):
    def seconds(modules):
        files = synthetic_tree(spark, modules).repartition(4).cache()
        files.count()
        start = time.perf_counter()
        E.hypotheses(files, KEY).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(12)
    small, large = seconds(12), seconds(240)
    assert large / 240 <= 4 * small / 12 + 0.001


def test_selection_spreads_and_never_overlaps(spark):
    for shared in (False, True):
        files = synthetic_tree(spark, 12, shared_constants=shared)
        candidates = E.usable(E.harvest(files, KEY, KEY), 4).cache()
        judged = E.choose(candidates, 24).cache()
        chosen = judged.where("reason is null").join(candidates, ["file", "start"]).collect()
        assert len(chosen) == 24 and len({r.file for r in chosen}) == 12
        primaries = [r.locations[r.primary] for r in chosen]
        assert len(set(primaries)) == len(primaries)
        for a in chosen:
            for b in chosen:
                if a.file == b.file and a.start != b.start:
                    assert not (a.st_start <= b.start < a.st_end or a.sc_start <= b.start < a.sc_end)
        assert judged.where("reason is not null").count() >= 0


def _chosen(spark, tree, target):
    files = spark.createDataFrame([(f, "javascript", text) for f, text in tree.items()], "file string, language string, text string")
    candidates = E.usable(E.harvest(files, KEY, KEY), 4).cache()
    judged = E.choose(candidates, target).collect()
    assert len(judged) == len({(r.file, r.start) for r in judged}) == candidates.count()
    return [r for r in judged if r.reason is None]


def test_selection_looks_past_many_copies(spark):
    tree = {f"copy{i}.js": "function a() { return 5005; }\n" for i in range(40)}
    tree["own.js"] = "// stands later than the copies\nfunction b(x) { return x + 7007; }\n"
    assert {r.file == "own.js" for r in _chosen(spark, tree, 2)} == {True, False}


def test_selection_looks_past_a_long_table(spark):
    table = ", ".join(str(5040 * i + 1009) for i in range(1, 201))
    text = f"function table() {{ return [{table}]; }}\nfunction b(x) {{ return x + 7007; }}\n"
    chosen = _chosen(spark, {"a.js": text}, 2)
    assert len(chosen) == 2 and max(r.start for r in chosen) > text.index("function b")
