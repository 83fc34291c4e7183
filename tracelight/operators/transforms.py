"""Seventeen edits of a source tree that a copier might make, as Column expressions or pandas functions.

Each takes and gives ``file, language, text``; ``changed`` counts the files that differ.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _replacing(pairs: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    """Whole words replaced by others."""

    def run(files: DataFrame) -> DataFrame:
        t = F.col("text")
        for old, new in pairs.items():
            t = F.regexp_replace(t, rf"\b{re.escape(old)}\b", new)
        return files.withColumn("text", t)

    return run


def _by_text(f: Callable[[str, str], str]) -> Callable[[DataFrame], DataFrame]:
    """A function of text and language, a batch at a time."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(text=[f(t, lang) for t, lang in zip(p["text"], p["language"])])

    return lambda files: files.select("file", "language", "text").mapInPandas(batches, "file string, language string, text string")


def _reformatted(text: str, language: str) -> str:
    lines = []
    for line in text.split("\n"):
        indent = len(line) - len(line.lstrip(" "))
        lines.append(" " * (indent * 2) + line.strip())
    return "\n".join(lines)


def _without_comments(files: DataFrame) -> DataFrame:
    own = lambda line: ~F.regexp_like(line, F.lit(r"^\s*(//|#)"))
    return files.withColumn("text", F.array_join(F.filter(F.split("text", "\n"), own), "\n"))


def _moved(files: DataFrame) -> DataFrame:
    first = files.where(F.col("file").startswith("src/")).agg(F.min("file").alias("_first"))
    moved = F.when(F.col("file") == F.col("_first"), F.concat(F.lit("lib/"), F.substring(F.col("file"), F.lit(5), F.length("file")))).otherwise(F.col("file"))
    return files.crossJoin(F.broadcast(first)).withColumn("file", moved).drop("_first")  # one row beside each


def _extracted(text: str, language: str) -> str:
    m = re.search(r"^(\s*)return ([^\n;]+)", text, re.M)
    if not m:
        return text
    if language == "python":
        return text[: m.start()] + f"{m[1]}lifted = {m[2]}\n{m[1]}return lifted" + text[m.end() :]
    return text[: m.start()] + f"{m[1]}const lifted = {m[2]};\n{m[1]}return lifted" + text[m.end() :]


def _inlined(text: str, language: str) -> str:
    return re.sub(r"(?m)^(\s*)(?:const )?(\w+) = ([^\n;=]+);?\n\1return \2;?$", r"\1return \3", text)


def _rewritten(text: str, language: str) -> str:
    return re.sub(r"\b(\w+) \+ (\w+)\b", r"\2 + \1", text)


def _hexed(text: str, language: str) -> str:
    return re.sub(r"(?<![\w.\"'])([1-9]\d{0,14})(?![\w.\"'])", lambda m: hex(int(m[1])), text)


def _decimal(text: str, language: str) -> str:
    return re.sub(r"\b0[xX]([0-9a-fA-F]{1,15})\b", lambda m: str(int(m[1], 16)), text)


def _imports(text: str, language: str) -> str:
    if language == "python":
        return "import sys as _unused\n" + text
    return re.sub(r"(?m)^export (function|const|class) (\w+)", r"\1 \2", text) + "\n" + "".join(f"export {{ {n} }};\n" for n in re.findall(r"(?m)^export (?:function|const|class) (\w+)", text))


def _without_dead_classes(text: str, language: str) -> str:
    blocks = re.split(r"\n(?=\S)", text)
    keep = []
    for b in blocks:
        m = re.match(r"(?:export )?class (\w+)", b)
        if not m or len(re.findall(rf"\b{m[1]}\b", text)) > 1:
            keep.append(b)
    return "\n".join(keep)


def _reordered(files: DataFrame) -> DataFrame:
    blocks = F.filter(F.split("text", "\n\n"), lambda b: F.length(F.trim(b)) > 0)
    return files.withColumn("text", F.array_join(F.reverse(blocks), "\n\n"))


def _stubs(text: str, language: str) -> str:
    if language == "python":
        return re.sub(r"(?m)^(\s*)(def [^\n]+:)\n(?:\1\s+[^\n]*\n?|\s*\n)+", r"\1\2\n\1    pass\n", text)
    return re.sub(r"\{[^{}]*\}", "{}", text)


def _renderings(old: str, new: Callable[[str], str] | None):
    """Renderings of known sites (rendered, original) put back, or spelled in another way."""

    def run(files: DataFrame, sites: DataFrame) -> DataFrame:
        pairs = sites.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("rendered", "original"))).alias("_p"))
        joined = files.join(pairs, "file", "left")

        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                out = []
                for text, own in zip(p["text"], p["_p"]):
                    for r in [] if own is None else own:
                        text = text.replace(r["rendered"], new(r["rendered"]) if new else r["original"])
                    out.append(text)
                yield p.drop(columns="_p").assign(text=out)

        return joined.select("file", "language", "text", "_p").mapInPandas(batches, "file string, language string, text string")

    return run


def _respelled(text: str) -> str:
    m = re.fullmatch(r"\((\d+) ([+*]) (\d+)\)", text)
    return f"({m[3]} {m[2]} {m[1]})" if m else text.replace("(", "( ").replace(")", " )")


TRANSFORMS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "variable_rename": _replacing({"total": "amount", "value": "item", "result": "outcome", "name": "label"}),
    "function_rename": _replacing({"render": "draw", "compute": "derive", "load": "fetch", "main": "entry"}),
    "class_rename": _replacing({"Report": "Summary", "Palette": "Colours", "Client": "Caller"}),
    "formatting": _by_text(_reformatted),
    "comment_removal": _without_comments,
    "file_movement": _moved,
    "function_extraction": _by_text(_extracted),
    "function_inlining": _by_text(_inlined),
    "expression_rewrite": _by_text(_rewritten),
    "constant_rewrite": _by_text(_hexed),
    "import_changes": _by_text(_imports),
    "dead_code_removal": _by_text(_without_dead_classes),
    "code_reordering": _reordered,
    "constant_normalization": _by_text(_decimal),
    "module_rebuild": _by_text(_stubs),
}
SITE_TRANSFORMS = {"artifact_removal": _renderings("rendered", None), "site_rewrite": _renderings("rendered", _respelled)}


def apply(files: DataFrame, name: str, sites: DataFrame | None = None) -> DataFrame:
    if name in SITE_TRANSFORMS:
        return SITE_TRANSFORMS[name](files, sites)
    return TRANSFORMS[name](files)


def changed(before: DataFrame, after: DataFrame) -> int:
    """Files of ``after`` that are not, word for word, in ``before``."""
    return after.select("file", "text").exceptAll(before.select("file", "text")).count()


def fraction(files: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Every file whose place by name, modulo the denominator, is below the numerator."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.orderBy("file")) - 1  # a tree of source files, not a corpus
    return files.withColumn("_p", place).where(F.col("_p") % denominator < numerator).drop("_p")


def encodings(secret: bytes) -> list[bytes]:
    """The spellings of a secret that a sweep looks for."""
    import base64
    from urllib.parse import quote_from_bytes

    h = secret.hex()
    plain, url = base64.b64encode(secret), base64.urlsafe_b64encode(secret)
    b32 = base64.b32encode(secret)
    return list(dict.fromkeys([secret, h.encode(), h.upper().encode(), ":".join(h[i : i + 2] for i in range(0, len(h), 2)).encode(), plain, plain.rstrip(b"="), url, url.rstrip(b"="), quote_from_bytes(secret).encode(), b32.lower().rstrip(b"="), b32.rstrip(b"=")]))


def sweep(files: DataFrame, needles: list[bytes]) -> DataFrame:
    """Files (file, content) that hold one of a few needles, and which."""
    hit = lambda n: F.contains(F.col("content"), F.lit(n))
    found = F.array_compact(F.array(*[F.when(hit(n), F.lit(i)) for i, n in enumerate(needles)]))
    return files.select("file", found.alias("needles")).where(F.size("needles") > 0)
