"""Writing codes into literals: harvest, selection, respelling, and reading them back.

Everything up to the choice of sites runs in parallel by file.  The choice itself depends on all
choices before it, so one task makes it.  It reads the first files and the first places of each, a
multiple of the wanted number of sites; where these run out before the target is met it is made again
over eight times as many, up to all, so that the outcome is that of the whole queues.
"""

from __future__ import annotations

import hashlib
import hmac
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelight.functions import literals as L
from tracelight.functions.keys import framed_bytes
from tracelight.operators import source_code as S
from tracelight.sources.archives import NOT_EXAMINED

QUEUE_FACTOR = 8
NUMBER_FAMILIES = ("add", "sub", "mul", "radix")
STRING_FAMILIES = ("str-concat", "str-escape")

CANDIDATES = "file string, start int, end int, st_start int, st_end int, sc_start int, sc_end int, line int, class string, original string, locations array<string>, priority string"
HYPOTHESES = "file string, start int, end int, tokens int, line int, text string, locations array<string>"


def _location(key: bytes, slot: int, digest: bytes) -> str:
    return hmac.new(key, framed_bytes("location", bytes([slot]), digest), hashlib.sha256).digest()[:16].hex()


def expected_code(key: bytes, location: str, width: int) -> int:
    mac = hmac.new(key, framed_bytes("tag", bytes.fromhex(location), bytes([width])), hashlib.sha256).digest()
    return int.from_bytes(mac[:4], "big") & ((1 << width) - 1)


def harvest(files: DataFrame, site_key: bytes, selection_key: bytes) -> DataFrame:
    """Literals of ``files`` (file, language, text) that can carry a code, with their four addresses."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CANDIDATES.split(", ")]
        for part in parts:
            rows = []
            for file, language, text in zip(part["file"], part["language"], part["text"]):
                for s in S.sites(S.analyse(text, language)):
                    places = [_location(site_key, k, d) for k, d in enumerate(s["digests"])]
                    priority = hmac.new(selection_key, "".join(places).encode(), hashlib.sha256).hexdigest()
                    rows.append((file, s["start"], s["end"], *s["statement"], *s["scope"], text.count("\n", 0, s["start"]) + 1, s["kind"], s["original"], places, priority))
            yield pd.DataFrame(rows, columns=names)

    return files.select("file", "language", "text").mapInPandas(run, CANDIDATES)


def hypotheses(files: DataFrame, site_key: bytes) -> DataFrame:
    """Every literal, and every short run of tokens that could spell one, with its four addresses."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in HYPOTHESES.split(", ")]
        for part in parts:
            rows = []
            for file, language, text in zip(part["file"], part["language"], part["text"]):
                analysis = S.analyse(text, language)
                for start, end, n in S.lone_literals(analysis) + S.windows(analysis):
                    if len(text[start:end].encode()) > 2 * S.LONGEST_LITERAL:
                        continue
                    digests, _, _ = S.addresses(analysis, start, end)
                    rows.append((file, start, end, n, text.count("\n", 0, start) + 1, text[start:end], [_location(site_key, k, d) for k, d in enumerate(digests)]))
            yield pd.DataFrame(rows, columns=names)

    return files.select("file", "language", "text").mapInPandas(run, HYPOTHESES)


def not_probed(files: DataFrame, what: str = "windows") -> DataFrame:
    """``file, reason, kind``: files of which only the first ``windows``, or ``sites``, are looked at, since there are too many."""
    ask, most = {"windows": (S.windows, S.MOST_WINDOWS), "sites": (S.sites, S.MOST_SITES)}[what]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file, language, text in zip(part["file"], part["language"], part["text"]):
                analysis = S.analyse(text, language)
                ask(analysis)
                if what in analysis.capped:
                    rows.append((file, f"too-many-{what}", NOT_EXAMINED))
            yield pd.DataFrame(rows, columns=["file", "reason", "kind"])

    # a token starts fewer windows than MOST_FORM_TOKENS, so shorter texts have too few tokens
    long = F.length("text") * S.MOST_FORM_TOKENS > most
    return files.where(long).select("file", "language", "text").mapInPandas(run, "file string, reason string, kind string")


def usable(candidates: DataFrame, width: int, strings: bool = True) -> DataFrame:
    """Candidates with the families that can carry ``width`` bits; those with none are left out."""
    number = L.families_for(L.integer_value(F.col("original")), width)
    inner = L.string_value(F.col("original"))
    carried = F.array_compact(F.array(*[F.when(L.string_supports(inner, f, width), F.lit(f)) for f in STRING_FAMILIES]))
    families = F.when(F.col("class") == "integer", number).otherwise(carried)
    out = candidates.withColumn("families", families).where(F.size("families") > 0)
    return out if strings else out.where("class = 'integer'")


def choose(candidates: DataFrame, target: int) -> DataFrame:
    """Up to ``target`` candidates that do not disturb one another, spread over the files.

    Gives ``file, start, primary`` and, for those passed over, ``reason``; every candidate has a row.
    """
    reach = F.greatest("st_end", "sc_end")
    queue = W.partitionBy("file").orderBy(reach, "priority")
    ranked = candidates.withColumn("reach", reach).withColumn("place", F.row_number().over(queue)).withColumn("queued", F.count(F.lit(1)).over(W.partitionBy("file")))
    counted = candidates.select(F.posexplode("locations").alias("slot", "loc")).groupBy("slot", "loc").agg(F.count(F.lit(1)).alias("twins"))
    twins = candidates.select("file", "start", F.posexplode("locations").alias("slot", "loc")).join(counted, ["slot", "loc"])
    twins = twins.groupBy("file", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "twins"))), lambda x: x["twins"]).alias("twins"))
    first = candidates.groupBy("file").agg(F.min(F.struct(reach.alias("reach"), "priority")).alias("best")).cache()
    count = first.count()
    share = -(-target // max(1, count))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        more_files = bool(pdf["more"].iloc[0])
        pdf = pdf.sort_values(["best_reach", "best_priority", "file", "place"], kind="stable")
        pdf["key"] = [tuple(x) for x in pdf["locations"]]
        queues = {f: deque(g.to_dict("records")) for f, g in pdf.groupby("file", sort=False)}
        cut_short = set(pdf.loc[pdf["queued"] > pdf.groupby("file")["place"].transform("max"), "file"])
        chosen, taken, held, out = [], set(), dict.fromkeys(queues, 0), []
        covers = lambda r, a, b: r[0] <= a < r[1] or r[0] <= b - 1 < r[1]

        def judge(c: dict) -> tuple[int | None, str | None]:
            for o in chosen:
                if o["file"] == c["file"] and (
                    covers((c["st_start"], c["st_end"]), o["start"], o["end"]) or covers((c["sc_start"], c["sc_end"]), o["start"], o["end"])
                    or covers((o["st_start"], o["st_end"]), c["start"], c["end"]) or covers((o["sc_start"], o["sc_end"]), c["start"], c["end"])
                ):
                    return None, "overlapping-radius"
                if o["key"] == c["key"]:
                    return None, "indistinguishable"
            free = [k for k in range(4) if c["locations"][k] not in taken]
            return (min(free, key=lambda k: (c["twins"][k], k)), None) if free else (None, "identity-taken")

        def ran_out() -> bool:
            for allowed in dict.fromkeys((max(1, share), target)):
                moved = True
                while moved and len(chosen) < target:
                    moved = False
                    for f, q in queues.items():
                        while held[f] < allowed and len(chosen) < target:
                            if not q:
                                if f in cut_short:
                                    return True
                                break
                            c, moved = q.popleft(), True
                            primary, reason = judge(c)
                            out.append((c["file"], c["start"], primary, reason))
                            if reason is None:
                                taken.add(c["locations"][primary])
                                chosen.append(c)
                                held[f] += 1
                                break
                    if more_files and len(chosen) < target:
                        return True
            return False

        if ran_out():
            out = [(None, None, None, "ran-out")]
        return pd.DataFrame(out, columns=["file", "start", "primary", "reason"]).astype({"start": "Int32", "primary": "Int32"})

    files, places = QUEUE_FACTOR * target, QUEUE_FACTOR * max(8, target)
    while True:
        more = files < count
        order = F.broadcast(first.orderBy("best", "file").limit(files)) if more else first
        bounded = ranked.where(F.col("place") <= places).join(order.select("file", "best"), "file").join(twins, ["file", "start"])
        flat = bounded.withColumn("best_reach", F.col("best.reach")).withColumn("best_priority", F.col("best.priority")).drop("best", "families")
        tried = flat.withColumn("more", F.lit(more)).groupBy("more").applyInPandas(greedy, "file string, start int, primary int, reason string").cache()
        if not tried.where("reason = 'ran-out'").limit(1).count():
            break
        tried.unpersist()
        files, places = QUEUE_FACTOR * files, QUEUE_FACTOR * places
    first.unpersist()
    rest = candidates.select("file", "start").join(tried, ["file", "start"], "left_anti")
    return tried.unionByName(rest.select("file", "start", F.lit(None).cast("int").alias("primary"), F.lit("constellation-full").alias("reason")))


def rendered(sites: DataFrame, width: int) -> DataFrame:
    """Adds ``rendered``, the first family's spelling with the site's ``code``."""
    value, inner = L.integer_value(F.col("original")), L.string_value(F.col("original"))
    quote = F.substring("original", 1, 1)
    spelled = F.lit(None).cast("string")
    for f in NUMBER_FAMILIES:
        spelled = F.when(F.col("family") == f, L.render(value, f, F.col("code"), width)).otherwise(spelled)
    for f in STRING_FAMILIES:
        for q in ('"', "'"):
            spelled = F.when((F.col("family") == f) & (quote == q), L.render_string(inner, f, F.col("code"), width, q)).otherwise(spelled)
    return sites.withColumn("rendered", spelled)


def read_code(text: Column, family: Column, width: int) -> Column:
    """The code that a text carries in the family recorded for its site, or null."""
    out = F.lit(None).cast("int")
    for f in NUMBER_FAMILIES:
        out = F.when(family == f, L.decode(text, f, width)[1]).otherwise(out)
    for f in STRING_FAMILIES:
        both = F.coalesce(L.decode_string(text, f, width, '"')[1], L.decode_string(text, f, width, "'")[1])
        out = F.when(family == f, both.cast("int")).otherwise(out)
    return out


def apply(files: DataFrame, sites: DataFrame, site_key: bytes) -> tuple[DataFrame, DataFrame]:
    """(files with the renderings spliced in, sites that still stand at their primary address).

    Each file is taken apart again after the edits; a site whose address changed is undone.
    """
    packed = sites.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "end", "rendered", "original", "primary", "locations"))).alias("edits"))
    joined = files.join(packed, "file", "left")

    def splice(text: str, edits: list) -> tuple[str, list[tuple[int, int]]]:
        out, at, shift, spans = [], 0, 0, []
        for e in edits:
            out += [text[at : e["start"]], e["rendered"]]
            spans.append((e["start"] + shift, e["start"] + shift + len(e["rendered"])))
            shift += len(e["rendered"]) - (e["end"] - e["start"])
            at = e["end"]
        return "".join(out) + text[at:], spans

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file, language, text, edits in zip(part["file"], part["language"], part["text"], part["edits"]):
                good = [] if edits is None else list(edits)
                while True:
                    new, spans = splice(text, good)
                    analysis = S.analyse(new, language)
                    proven = [_location(site_key, e["primary"], S.addresses(analysis, *s)[0][e["primary"]]) == e["locations"][e["primary"]] for e, s in zip(good, spans)]
                    if all(proven):
                        break
                    good = [e for e, ok in zip(good, proven) if ok]
                rows.append((file, language, new, [e["start"] for e in good]))
            yield pd.DataFrame(rows, columns=["file", "language", "text", "kept"])

    done = joined.select("file", "language", "text", "edits").mapInPandas(run, "file string, language string, text string, kept array<int>")
    kept = done.select("file", F.explode("kept").alias("start"))
    return done.drop("kept"), sites.join(kept, ["file", "start"], "left_semi")
