"""Personal data by generated candidates, boosted trees and calibrated thresholds, in SQL expressions.

*Base spans* are the matches of four fixed formats: email, ip, card and phone.  They are always in the
result.  *Candidates* come from wide patterns that may overlap one another and the base spans: long
mixed tokens (``secret``), written-out addresses (``mail``), numbers that look like a telephone without
a plus sign (``tel``), and numbers of the form 3-2-4 digits (``ssn``).  Each candidate has features of
its format and of the text around it, boosted trees score it, and it is a span if the score reaches the
threshold of its kind.

All of this is one projection of built-in functions on the row of the document: no join, no shuffle, no
Python.  Patterns are written so that Java's matcher needs no recursion on long texts: what a repeated
group would decide is first decided character by character with look-around, in a copy of the text of
equal length.  A match carries its own text and what stands next to it, and positions are summed in
blocks, so that the work grows with the text, however many matches it has.  The trees are trained on the driver, in numpy, on some thousand short made-up texts whose
features the same expressions compute.

Positions are code points, ends exclusive.  A null text is empty and has no spans (``redact`` keeps it
null); an empty table gives no rows; repeated rows get equal results; columns other than ``doc_id`` and
``text`` are not read, whatever their names.
"""

from __future__ import annotations

import functools
import json
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
MORE = ("secret", "mail", "tel", "ssn")

# formats of the base spans and candidates, on texts prepared by _prepared
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{12,}+"
MAIL = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{2,40}+ ?(?:\.|[\[(]dot[\])]) ?[A-Za-z]{2,10}+"
TEL = r"(?<![0-9A-Za-z+.-])(?<!\+[0-9]{1,3} )\(?[0-9][0-9 ().-]{6,18}[0-9](?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"

_BEFORE = 24
FEATURES = ("length", "digits", "upper", "hex", "groups", "told_secret", "told_number", "told_mail", "told_id", "given", "quoted", "separators", "mixed", "kind")


# -- arrays, in time linear in their length --------------------------------------------------------

#: Elements that are folded together, and characters of a piece of a text that is cut.
BLOCK = 256
_NO_SPANS = "cast(array() as array<struct<s:int,e:int,h:string,b:string,a:string>>)"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often and deep the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, start: int, step) -> Column:
    """For each number of a non-empty array, ``step`` folded over ``start`` and the numbers before it.

    A fold that collects what it passes copies its list at each step, so it is done in blocks: over the
    results of the blocks first, then inside each.
    """

    def collected(xs: Column, first: Column) -> Column:
        empty = F.struct(first.alias("p"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(xs, empty, lambda acc, x: F.struct(step(acc["p"], x).alias("p"), F.concat(acc["out"], F.array(acc["p"])).alias("out")), lambda acc: acc["out"])

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))

        def inside(bs: Column) -> Column:
            folded = F.transform(bs, lambda b: F.aggregate(b, F.lit(start), step))
            return F.flatten(F.zip_with(bs, collected(folded, F.lit(start)), collected))

        return _let(blocks, inside)

    return _let(values, of)


# -- spans of a pattern ----------------------------------------------------------------------------


def _places(text: Column, pattern: str) -> Column:
    """Array of the leftmost matches that do not overlap: start s, end e, the match h, ``_BEFORE`` characters b before it, one a after it."""

    def placed(gaps: Column, hits: Column) -> Column:
        sizes = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))
        tail = lambda xs: F.transform(xs, lambda x: F.right(x, F.lit(_BEFORE)))

        def spans(at: Column, gap_ends: Column, hit_ends: Column) -> Column:
            def span(h: Column, i: Column) -> Column:
                # a match has 8 characters or more where b is used, so three before it reach far enough
                near = [F.get(xs, i - k) for k in (3, 2, 1) for xs in (gap_ends, hit_ends)] + [F.get(gap_ends, i)]
                s = F.get(at, i) + F.length(F.get(gaps, i))
                after = F.left(F.concat_ws("", F.left(F.get(gaps, i + 1), F.lit(1)), F.left(F.get(hits, i + 1), F.lit(1))), F.lit(1))
                return F.struct(s.alias("s"), (s + F.length(h)).alias("e"), h.alias("h"), F.right(F.concat_ws("", *near), F.lit(_BEFORE)).alias("b"), after.alias("a"))

            return F.transform(hits, span)

        return _let(_running(sizes, 0, lambda p, x: p + x), lambda at: _let(tail(gaps), lambda g: _let(tail(hits), lambda h: spans(at, g, h))))

    found = _let(F.split(text, pattern, -1), lambda g: _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: placed(g, h)))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.expr(_NO_SPANS))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _prepared(df: DataFrame) -> DataFrame:
    """Copies of the text of equal length: dots outside names made ``_``, separators outside numbers ``x``."""
    dots = F.regexp_replace("_t", r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])", "_")
    lone = F.regexp_replace("_t", r"(?<![0-9])[ -]|[ -](?![0-9])", "x")
    return df.withColumn("_m", F.when(F.col("_t").contains("@"), dots).otherwise("")).withColumn("_n", F.when(F.regexp_like("_t", F.lit("[0-9]")), lone).otherwise(""))


def _base(df: DataFrame) -> DataFrame:
    t = F.col("_t")
    small = lambda part: F.length(F.regexp_replace(part, "^0+(?=.)", "")) <= 3
    in_range = lambda x: F.forall(F.split(x["h"], r"\."), lambda p: small(p) & (F.regexp_replace(p, "^0+(?=.)", "").try_cast("long") <= 255))
    digits = lambda x: F.regexp_replace(x["h"], "[^0-9]", "")
    card = lambda x: F.length(digits(x)).between(13, 19) & _luhn(digits(x))
    df = df.withColumn("_email", _places(F.col("_m"), EMAIL))
    df = df.withColumn("_ip", F.filter(_places(t, IP), in_range))
    df = df.withColumn("_card", F.filter(_places(F.col("_n"), CARD), card))
    return df.withColumn("_phone", F.filter(_places(t, PHONE), lambda x: F.length(digits(x)).between(9, 15)))


# -- candidates and their features -----------------------------------------------------------------


def _features(kind: str, x: Column) -> Column:
    own, before, after = x["h"], F.lower(x["b"]), x["a"]
    n = F.length(own).cast("double")
    count = lambda p: F.length(F.regexp_replace(own, p, "")).cast("double")
    flag = lambda c, p: F.regexp_like(c, F.lit(p)).cast("double")
    values = {
        "length": n,
        "digits": count("[^0-9]") / n,
        "upper": count("[^A-Z]") / n,
        "hex": flag(own, "^[0-9a-fA-F]+$"),
        "groups": F.size(F.regexp_extract_all(own, F.lit("[0-9]+"), F.lit(0))).cast("double"),
        "told_secret": flag(before, "token|key|secret|passw|pwd|auth|bearer|credential"),
        "told_number": flag(before, "tel|phone|call|mobile|fax|cell|ring"),
        "told_mail": flag(before, "mail|contact|write|reach"),
        "told_id": flag(before, "ssn|social|security|insurance"),
        "given": flag(before, "[=:] ?[\"']?$"),
        "quoted": (flag(before, "[\"'`]$") + flag(after, "^[\"'`]")) / 2,
        "separators": count("[A-Za-z0-9]") / n,
        "mixed": flag(own, "[a-z]") * flag(own, "[A-Z]") * flag(own, "[0-9]"),
        "kind": F.lit(float(MORE.index(kind))),
    }
    return F.struct(*[values[f].alias(f) for f in FEATURES], x["s"].alias("s"), x["e"].alias("e"))


_PATTERNS = {"secret": SECRET, "mail": MAIL, "tel": TEL, "ssn": SSN}
#: What a text must hold before the pattern of a kind is tried at all.
_HINTS = {"secret": "[0-9]", "mail": r"[\[(]at[\])]", "tel": "[0-9][ ().-]{0,3}[0-9]", "ssn": "-[0-9]{2}-"}


def _candidates(kind: str, text: Column) -> Column:
    tried = F.when(F.regexp_like(text, F.lit(_HINTS[kind])), text).otherwise("")
    return F.transform(_places(tried, _PATTERNS[kind]), lambda x: _features(kind, x))


# -- boosted trees ---------------------------------------------------------------------------------


def _made_up(n: int, seed: int) -> list[tuple[str, str, int]]:
    """(text, kind, label) of texts that hold one candidate or more of the kind, all with the label."""
    rng = random.Random(seed)
    pick, digits = rng.choice, lambda k: "".join(rng.choice(string.digits) for _ in range(k))
    chars = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    word = lambda: chars(string.ascii_lowercase, rng.randint(2, 9))
    words = lambda k: " ".join(word() for _ in range(k))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    secret = lambda: pick([chars(hexes, 40), chars(hexes, 32), chars(alnum, rng.randint(20, 44)), "sk-" + chars(alnum, 32), "AKIA" + chars(string.ascii_uppercase + string.digits, 16)])
    named = lambda: pick(["token", "api_key", "secret", "password", "access key", "Authorization: Bearer", "credential"])
    out = []
    for _ in range(n):
        quote = pick(['"', "'", ""])
        out += [
            (f"{words(3)} {named()}{pick([' = ', '=', ': '])}{quote}{secret()}{quote} {words(2)}", "secret", 1),
            (f"{words(4)} {pick(['commit', 'sha', 'build', 'file', 'md5', 'see', 'version'])} {pick([chars(hexes, 40), chars(hexes, 32), word() + '-' + word() + digits(4), digits(14), word() + '_' + word() + digits(2)])} {words(3)}", "secret", 0),
            (f"{words(5)} {pick([digits(16), digits(13), word() + word() + digits(3), digits(4) + '-' + digits(2) + '-' + digits(2) + '-' + word()])} {words(3)}", "secret", 0),
            (f"{words(2)} {pick(['mail', 'contact', 'write to', ''])} {word()}{pick([' (at) ', '[at]', ' [at] '])}{word()}{pick(['.', ' [dot] ', '(dot)'])}{pick(['com', 'org', 'de'])} {words(2)}", "mail", 1),
            (f"{words(2)} {pick(['look', 'met', 'stop'])} {word()} (at) {digits(2)} . {word()} {words(2)}", "mail", 0),
            (f"{words(3)} {pick(['tel', 'phone', 'call', 'Mobile:', 'fax', 'Tel.'])} {pick([f'({digits(3)}) {digits(3)}-{digits(4)}', f'{digits(3)}-{digits(3)}-{digits(4)}', f'0{digits(3)} {digits(7)}', f'{digits(3)}.{digits(3)}.{digits(4)}'])} {words(2)}", "tel", 1),
            (f"{words(4)} {pick([f'({digits(3)}) {digits(3)}-{digits(4)}', f'{digits(3)}-{digits(3)}-{digits(4)}'])} {words(2)}", "tel", 1),
            (f"{words(3)} {pick(['on', 'from', 'id', 'in', 'isbn', 'no'])} {pick([f'20{digits(2)}-{digits(2)}-{digits(2)}', f'{digits(4)}.{digits(2)}.{digits(2)}', digits(10), digits(16), f'{digits(3)}-{digits(1)}-{digits(5)}-{digits(2)}', f'{digits(4)} {digits(4)}', f'{digits(2)}.{digits(2)}.{digits(2)}.{digits(2)}', f'{digits(4)} {digits(4)} {digits(4)} {digits(4)}'])} {words(3)}", "tel", 0),
            (f"{words(3)} {pick(['ssn', 'social security', 'SSN:', 'id'])} {digits(3)}-{digits(2)}-{digits(4)} {words(2)}", "ssn", 1),
            (f"{words(3)} {pick(['ssn', 'social security', 'SSN:', 'id'])} {digits(3)}-{digits(2)}-{digits(4)} {words(2)}", "tel", 0),
            (f"{words(3)} {pick(['part', 'item', 'room'])}={digits(3)}-{digits(2)}-{digits(4)} {words(2)}", "ssn", 0),
        ]
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float = 4.0) -> tuple | float:
    """A regression tree on gradients: (feature, cut, left, right) or the value of a leaf."""
    total_g, total_h = g.sum(), h.sum()
    leaf = float(-total_g / (total_h + 1.0))
    if depth == 0 or len(g) < 8:
        return leaf
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        ok = (v[1:] > v[:-1]) & (ch >= least / 4) & (total_h - ch >= least / 4)
        if ok.any():
            gain = np.where(ok, cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1), -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[left], g[left], h[left], depth - 1, least), _grow(x[~left], g[~left], h[~left], depth - 1, least)


def _value(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, at, left, right = tree
    return np.where(x[:, f] <= at, _value(left, x), _value(right, x))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3) -> list:
    """Trees whose sum is the logit of the label; leaves are scaled already."""
    trees, score = [], np.zeros(len(y))
    scaled = lambda t: (t[0], t[1], scaled(t[2]), scaled(t[3])) if isinstance(t, tuple) else t * rate
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = scaled(_grow(x, p - y, np.maximum(p * (1 - p), 1e-6), depth))
        trees.append(tree)
        score += _value(tree, x)
    return trees


def calibrated(score: np.ndarray, y: np.ndarray, kind: np.ndarray, precision: float = 0.98) -> list[float]:
    """By kind, the lowest threshold whose precision is reached on held-out scores; infinite if none is."""
    out = []
    for k in range(len(MORE)):
        s, t = score[kind == k], y[kind == k]
        cuts = [c for c in np.unique(s) if t[s >= c].mean() >= precision]
        below = s[s < min(cuts)] if cuts else s
        out.append(float((min(cuts) + below.max()) / 2 if len(below) else min(cuts) - 0.5) if cuts else float("inf"))
    return out


@functools.cache
def _trained(application: str, size: int, seed: int) -> tuple[list, list[float]]:
    spark = SparkSession.active()
    rows = [{"t": t, "k": k, "y": y} for t, k, y in _made_up(size, seed)]
    made = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<t:string,k:string,y:int>>")).alias("r")).select("r.*")
    found = F.lit(None)
    for kind in MORE:
        found = F.when(F.col("k") == kind, _candidates(kind, F.col("t"))).otherwise(found)
    table = made.select("y", F.explode(found).alias("c")).select("y", "c.*").collect()  # a few rows for each made-up text
    table.sort(key=tuple)
    x, y = np.array([[r[f] for f in FEATURES] for r in table]), np.array([r["y"] for r in table])
    held = np.arange(len(y)) % 3 == 0
    trees = boost(x[~held], y[~held])
    score = sum(_value(t, x[held]) for t in trees)
    return trees, calibrated(score, y[held], x[held, -1])


def _expression(tree: tuple | float, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, at, left, right = tree
    return F.when(c[FEATURES[f]] <= F.lit(at), _expression(left, c)).otherwise(_expression(right, c))


# -- results ---------------------------------------------------------------------------------------


def pii_spans(docs: DataFrame, *more: str, size: int = 160, seed: int = 3) -> DataFrame:
    """``doc_id``, the columns in ``more``, ``_t`` (the text) and an array of (s, e) in ``_<kind>`` for each kind."""
    spark = docs.sparkSession
    trees, thresholds = _trained(spark.sparkContext.applicationId, size, seed)
    df = docs.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("_t"))
    df = _base(_prepared(df)).drop("_m", "_n")
    for kind, threshold in zip(MORE, thresholds):
        if threshold == float("inf"):
            df = df.withColumn(f"_{kind}", F.expr(_NO_SPANS))
            continue

        def good(c: Column) -> Column:
            total = _expression(trees[0], c)
            for t in trees[1:]:
                total = total + _expression(t, c)
            return total >= F.lit(threshold)

        kept = F.filter(_candidates(kind, F.col("_t")), good)
        df = df.withColumn(f"_{kind}", F.transform(kept, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"))))
    return df


def _told(kinds: tuple[str, ...]) -> Column:
    spell = lambda k: F.transform(F.col(f"_{k}"), lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")))
    return F.array_join(F.concat(*[spell(k) for k in kinds]), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base spans, the digest of their list, and the list of all spans."""
    df = pii_spans(docs)
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *counts, F.sha2(_told(BASE), 256).alias("base_sha256"), _told(BASE + MORE).alias("spans"))


def _cut_out(text: Column, start: Column, end: Column, pieces: Column) -> Column:
    """Characters ``start .. end - 1`` of the text whose pieces of ``BLOCK`` characters are given."""
    first = F.floor(start / BLOCK).cast("int")
    number = F.floor((end - 1) / BLOCK).cast("int") - first + 1
    return F.when(end > start, F.substring(F.array_join(F.slice(pieces, first + 1, F.greatest(number, F.lit(0))), ""), start % BLOCK + 1, end - start)).otherwise("")


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each of the sorted spans (s, -e, k) named; one that starts inside earlier ones goes with them."""

    def named(xs: Column, reached: Column, pieces: Column) -> Column:
        def said(x: Column, i: Column) -> Column:
            p = F.get(reached, i)
            return F.when(x["s"] >= p, F.concat(_cut_out(text, p, x["s"], pieces), x["k"])).otherwise("")

        last = F.greatest(F.element_at(reached, -1), -F.element_at(xs, -1)["ne"])
        return F.concat(F.array_join(F.transform(xs, said), ""), _cut_out(text, last, F.length(text), pieces))

    ends = lambda xs: F.transform(xs, lambda x: -x["ne"])
    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    return _let(spans, lambda xs: _let(_running(ends(xs), 0, lambda p, x: F.greatest(p, x)), lambda reached: _let(pieces, lambda ps: named(xs, reached, ps))))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in angle brackets, and ``n_chars`` to match.

    Of spans that overlap, the one that starts first is named, and the longest of those.
    """
    columns = docs.columns
    whole = docs.select("doc_id", "text", F.struct(*[docs[c] for c in columns]).alias("_row"))
    df = pii_spans(whole, "_row")
    every = F.concat(*[F.transform(F.col(f"_{k}"), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), F.lit(f"<{k.upper()}>").alias("k"))) for k in BASE + MORE])
    df = df.withColumn("_all", F.array_sort(every))
    t = F.col("_t")
    df = df.withColumn("_clean", F.when(F.size("_all") > 0, _replaced(t, F.col("_all"))).otherwise(t))
    own = {c: F.col("_row").getField(c) for c in columns}
    own["text"] = F.when(own["text"].isNotNull(), F.col("_clean"))
    if "n_chars" in own:
        own["n_chars"] = F.when(F.size("_all") > 0, F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return df.select(*[own[c].alias(c) for c in columns])
