"""A language-free token stream as Column expressions, and the window operators over it.

Tokens are cut by one alternation; their kinds follow from how they begin.  Positions are character
offsets, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What the bracket and operator tokens are.
OPENERS = ("(", "[", "{")
CLOSERS = (")", "]", "}")

TOKEN = (
    r"""[A-Za-z_$\x{80}-\x{10FFFF}][A-Za-z0-9_$\x{80}-\x{10FFFF}]*"""
    r"""|[0-9][A-Za-z0-9_.]*"""
    r"""|"[^"\n]*"|'[^'\n]*'"""
    r"""|[+\-*/%=<>!&|^~?]+"""
    r"""|[^\s]"""
)
#: The widest spelling has five tokens; one more is allowed.
MOST_FORM_TOKENS = 6


def token_texts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_kind(token: Column) -> Column:
    like = lambda p: F.regexp_like(token, F.lit(p))
    return (
        F.when(like(r"^[A-Za-z_$\x{80}-\x{10FFFF}]"), "word")
        .when(like("^[0-9]"), "number")
        .when(like("^([\"']).*\\1$") & (F.length(token) > 1), "string")
        .when(like(r"^[+\-*/%=<>!&|^~?]"), "operator")
        .otherwise("punct")
    )


def tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, pos, token, kind``: one row a token, in order."""
    out = df.select(key, F.posexplode(token_texts(F.col(text))).alias("pos", "token"))
    return out.withColumn("kind", token_kind(F.col("token")))


def bracket_delta(token: Column) -> Column:
    return F.when(token.isin(*OPENERS), 1).when(token.isin(*CLOSERS), -1).otherwise(0)


def bracket_depth(tokens_: DataFrame, key: str) -> DataFrame:
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return tokens_.withColumn("depth", F.sum(bracket_delta(F.col("token"))).over(w))


def is_material(kind: Column) -> Column:
    """Whether a token can be part of a spelled literal."""
    return kind.isin("number", "string", "operator", "punct")


def material_runs(tokens_: DataFrame, key: str) -> DataFrame:
    """``key, first, last, n``: maximal runs of material tokens."""
    w = W.partitionBy(key).orderBy("pos")
    island = F.col("pos") - F.row_number().over(w)
    runs = tokens_.where(is_material(F.col("kind"))).withColumn("island", island)
    return runs.groupBy(key, "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n")).drop("island")


def form_windows(tokens_: DataFrame, key: str) -> DataFrame:
    """``key, pos, n``: windows of 2 to 6 material tokens that could be a spelled literal.

    A window begins with a literal or an opening bracket, ends with a literal or a closing one, never
    closes more than it opened and is balanced at its end.
    """
    w = W.partitionBy(key).orderBy("pos").rowsBetween(0, MOST_FORM_TOKENS - 1)
    here = F.struct("pos", "token", "kind")
    ahead = tokens_.withColumn("ahead", F.collect_list(here).over(w))
    t = F.col("ahead")
    delta = F.transform(t, lambda x: bracket_delta(x["token"]))
    literal = lambda x: x["kind"].isin("number", "string")
    head = literal(t[0]) | t[0]["token"].isin(*OPENERS)
    depth = lambda n: F.aggregate(F.slice(delta, 1, n), F.lit(0), lambda a, d: a + d)
    good = lambda n: (
        (F.size(t) >= n)
        & (literal(F.try_element_at(t, n)) | F.try_element_at(t, n)["token"].isin(*CLOSERS))
        & F.forall(F.slice(t, 1, n), lambda x: is_material(x["kind"]))
        & (depth(n) == 0)
        & F.forall(F.sequence(F.lit(1), n), lambda k: depth(k) >= 0)
    )
    sizes = F.filter(F.array(*[F.lit(n) for n in range(2, MOST_FORM_TOKENS + 1)]), good)
    return ahead.where(head & is_material(F.col("kind"))).select(key, "pos", F.explode(sizes).alias("n"))


def number_hazards(tokens_: DataFrame, key: str) -> DataFrame:
    """``key, pos, token, hazard``: numbers that must not be rewritten where they stand."""
    w = W.partitionBy(key).orderBy("pos")
    before, after = F.lag("token").over(w), F.lead("token").over(w)
    near = tokens_.withColumn("before", before).withColumn("after", after).where("kind = 'number'")
    hazard = (
        F.when(F.col("before").isin(".", "#"), "member-or-directive")
        .when(F.col("before").isin("[", "{") & F.col("after").isin("]", "}"), "index")
        .when(F.col("after").isin(":"), "key")
        .when(F.col("after").isin(".", "%"), "part-of-a-larger-number")
    )
    return near.withColumn("hazard", hazard).where("hazard is not null").select(key, "pos", "token", "hazard")


def renamed_by_first_use(tokens_: DataFrame, key: str) -> DataFrame:
    """``key, token, first, number``: words numbered from 0 in the order of their first use."""
    firsts = tokens_.where("kind = 'word'").groupBy(key, "token").agg(F.min("pos").alias("first"))
    w = W.partitionBy(key).orderBy("first")
    return firsts.withColumn("number", F.row_number().over(w) - 1)


def escaped(value: Column) -> Column:
    """A token value in canonical text: blanks and angle brackets cannot be taken for marks."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for raw, coded in ((" ", "_"), ("<", "\\<"), (">", "\\>")):
        out = F.replace(out, F.lit(raw), F.lit(coded))
    return out


def literal_value(token: Column, kind: Column) -> Column:
    """``<n:value>`` or ``<s:text>`` of a literal; null for one without a plain value, which keeps its spelling.

    A number is a decimal or hexadecimal integer of up to 18 or 15 digits, a string has no backslash.
    """
    hexed = F.conv(F.substring(token, 3, 15), 16, 10)
    number = F.when(F.regexp_like(token, F.lit("^(0|[1-9][0-9]{0,17})$")), token).when(F.regexp_like(token, F.lit("^0[xX][0-9a-fA-F]{1,15}$")), hexed)
    inner = F.when(~F.contains(token, F.lit("\\")), escaped(F.substring(token, F.lit(2), F.length(token) - 2)))
    return F.when(kind == "number", F.concat(F.lit("<n:"), number, F.lit(">"))).when(kind == "string", F.concat(F.lit("<s:"), inner, F.lit(">")))


def canonical_texts(df: DataFrame, key: str, level: int, text: str = "text") -> DataFrame:
    """``key, canonical``: token text at a level.

    1 is exact; at 2 words are numbered by first use; at 3 literals are written by their value as well.
    The exact level is a projection.  The others run over exploded tokens, whose kinds and numbers are
    found once a token in generated code, and are put together again by ``key``, one row each in ``df``.
    """
    if level == 1:
        own = df.select(key, token_texts(F.col(text)).alias("_tokens"))
        return own.select(key, F.array_join(F.transform("_tokens", escaped), " ").alias("canonical"))
    t = tokens(df, key, text)
    numbers = renamed_by_first_use(t, key).select(key, "token", "number")
    value = literal_value(F.col("token"), F.col("kind")) if level == 3 else F.lit(None)
    piece = F.when(F.col("number").isNotNull(), F.concat(F.lit("#l"), F.col("number").cast("string"))).otherwise(F.coalesce(value, escaped(F.col("token"))))
    pieces = t.join(numbers, [key, "token"], "left").select(key, F.struct("pos", piece.alias("piece")).alias("p"))
    lines = pieces.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["piece"]), " ").alias("canonical"))
    return df.select(key).join(lines, key, "left").select(key, F.coalesce("canonical", F.lit("")).alias("canonical"))


def located_shapes(text: Column, shape: str) -> Column:
    """Array of the spellings of one shape that stand in the text."""
    return F.regexp_extract_all(text, F.lit(SHAPES[shape]), F.lit(0))


SHAPES = {
    "arithmetic": r"\([0-9]+ [+*-] [0-9]+\)",
    "mixed-hex": r"0x[0-9a-fA-F]+",
    "escaped": r"\"(?:\\x[0-9a-f]{2})+[^\"\\\n]*\"",
    "split": r"\(\"[^\"\n]+\" \+ \"[^\"\n]+\"\)",
}
