"""Literals, and the seven spellings that carry a code, as Column expressions.

A code of ``width`` bits is carried by how a value is spelled: as a sum, a difference, a product, by
the case of hexadecimal letters, or by where a string is split or how much of it is escaped.  Values are
BIGINT here; wider integers are refused as out of range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The families in order of preference, whether they spell numbers, and their most bits.
FAMILIES = {
    "add": ("integer", 8),
    "sub": ("integer", 8),
    "mul": ("integer", 6),
    "radix": ("integer", 4),
    "str-concat": ("string", 6),
    "str-escape": ("string", 5),
    "str-adjacent": ("string", 5),
}
LARGEST = 2**63 - 1


@dataclass(frozen=True)
class Dialect:
    name: str
    max_exact: int
    adjacent_strings: bool
    digit_separator: str | None


# What each language can represent exactly, and its string rules.
DIALECTS = {
    d.name: d
    for d in (
        Dialect("javascript", 2**53 - 1, False, "_"),
        Dialect("typescript", 2**53 - 1, False, "_"),
        Dialect("python", LARGEST, True, "_"),
        Dialect("generic", 2**53 - 1, False, None),
    )
}


def integer_refusal(text: Column, dialect: Dialect = DIALECTS["generic"]) -> Column:
    """Why a spelling is no plain integer; null if it is one."""
    t = F.trim(text)
    digits = F.regexp_replace(t, "^0[xXoObB]", "")
    like = lambda p: F.regexp_like(t, F.lit(p))
    base = F.when(like("^0[xX]"), 16).when(like("^0[oO]"), 8).when(like("^0[bB]"), 2).otherwise(10)
    fits = F.when(base == 16, F.length(F.regexp_replace(digits, "^0+", "")) <= 15).when(base == 8, F.length(F.regexp_replace(digits, "^0+", "")) <= 20).when(base == 2, F.length(F.regexp_replace(digits, "^0+", "")) <= 62).otherwise(F.length(F.regexp_replace(digits, "^0+", "")) <= 18)
    return (
        F.when(F.length(t) == 0, "not-a-literal")
        .when(t.contains("_"), "digit-separator")
        .when(t.contains("."), "floating-point")
        .when(like("[nN]$"), "big-int")
        .when(~like("^[0-9]"), "not-a-literal")
        .when(like("^0[0-9]"), "ambiguous-radix")
        .when(F.length(digits) == 0, "not-a-literal")
        .when((base == 10) & like("[eEfF]"), "floating-point")
        .when(~F.when(base == 16, like("^0[xX][0-9a-fA-F]+$")).when(base == 8, like("^0[oO][0-7]+$")).when(base == 2, like("^0[bB][01]+$")).otherwise(like("^[0-9]+$")), "not-a-literal")
        .when(~fits, "out-of-range")
        .when(_value(t) > dialect.max_exact, "not-exactly-representable")
    )


def _value(t: Column) -> Column:
    digits = F.regexp_replace(t, "^0[xXoObB]", "")
    base = F.when(F.regexp_like(t, F.lit("^0[xX]")), 16).when(F.regexp_like(t, F.lit("^0[oO]")), 8).when(F.regexp_like(t, F.lit("^0[bB]")), 2).otherwise(10)
    of = lambda b: F.conv(digits, b, 10).try_cast("bigint")
    return F.when(base == 16, of(16)).when(base == 8, of(8)).when(base == 2, of(2)).otherwise(of(10))


def integer_value(text: Column, dialect: Dialect = DIALECTS["generic"]) -> Column:
    return F.when(integer_refusal(text, dialect).isNull(), _value(F.trim(text)))


def string_refusal(text: Column) -> Column:
    """Why a spelling is no plain string literal; null if it is one."""
    quote, inner = F.substring(text, 1, 1), F.expr("null")
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    return (
        F.when(quote == "`", "multiline-or-template")
        .when(like(quote, "^[A-Za-z]$"), "string-prefix")
        .when(~quote.isin('"', "'"), "not-a-literal")
        .when(F.length(text) == 0, "not-a-literal")
        .when(F.substring(text, 1, 3) == F.repeat(quote, F.lit(3)), "multiline-or-template")
        .when((F.length(text) < 2) | (F.substring(text, -1, 1) != quote), "multiline-or-template")
        .when(F.length(inner) == 0, "empty-literal")
        .when(inner.contains("\\"), "contains-escape")
        .when(like(inner, "[\n\r]"), "multiline-or-template")
        .when(F.contains(inner, quote), "multiline-or-template")
    )


def string_value(text: Column) -> Column:
    return F.when(string_refusal(text).isNull(), F.substring(text, F.lit(2), F.length(text) - 2))


# -- what a value can carry ------------------------------------------------------------------------


def hex_letters(value: Column) -> Column:
    return F.length(F.regexp_replace(F.lower(F.hex(value)), "[0-9]", ""))


def _tried(m: int) -> Column:
    return F.array(*[F.lit(d).cast("long") for d in range(2, 8 * m + 1)])  # a literal, made once


def _divisors(value: Column, m: int) -> Column:
    """Operands of products: divisors up to 8m and what they leave, none over half of the value."""
    small = F.filter(_tried(m), lambda d: (value % d == 0) & (d < value))  # less than the value: half of it at most
    return F.flatten(F.transform(small, lambda d: F.array(d, F.call_function("div", value, d))))


def _covers(value: Column, m: int) -> Column:
    """Whether the operands have every residue mod m; up to 64 residues are the bits of one number."""
    if m > 64:
        return F.size(F.array_distinct(F.transform(_divisors(value, m), lambda d: d % m))) == m
    bit = lambda d: F.call_function("shiftleft", F.lit(1).cast("long"), (d % m).cast("int"))
    both = lambda d: bit(d).bitwiseOR(bit(F.call_function("div", value, d)))
    seen = F.aggregate(_tried(m), F.lit(0).cast("long"), lambda s, d: F.when((value % d == 0) & (d < value), s.bitwiseOR(both(d))).otherwise(s))
    return seen == (-1 if m == 64 else (1 << m) - 1)


def supports(value: Column, family: str, width: int, dialect: Dialect = DIALECTS["generic"]) -> Column:
    """Whether a number can carry every code of ``width`` bits in a family."""
    m = 1 << width
    exact = (value >= 0) & (value <= dialect.max_exact)
    if family == "add":
        return exact & (value > m)
    if family == "sub":
        # where a language has no largest number, the sum may pass BIGINT
        return exact if dialect.max_exact == LARGEST else exact & (value <= dialect.max_exact - m)
    if family == "mul":
        # residue 0 needs a divisor that m divides, so only multiples of m are searched
        return F.when(exact & (value >= 2) & (value % m == 0), _covers(value, m)).otherwise(F.lit(False))
    if family == "radix":
        return exact & (hex_letters(value) >= width)
    raise ValueError(f"{family} does not spell numbers")


def string_supports(inner: Column, family: str, width: int, dialect: Dialect = DIALECTS["generic"]) -> Column:
    m = 1 << width
    if family == "str-concat":
        return F.length(inner) > m
    if family == "str-adjacent":
        return F.lit(dialect.adjacent_strings) & (F.length(inner) > m)
    if family == "str-escape":
        return (F.length(inner) >= m) & F.regexp_like(F.left(inner, F.lit(m)), F.lit("^[\\x{0}-\\x{ff}]*$"))
    raise ValueError(f"{family} does not spell strings")


def families_for(value: Column, width: int, dialect: Dialect = DIALECTS["generic"]) -> Column:
    """Array of the families that can carry ``width`` bits of a number."""
    names = [f for f, (kind, bits) in FAMILIES.items() if kind == "integer"]
    return F.array_compact(F.array(*[F.when(supports(value, f, width, dialect), F.lit(f)) for f in names]))


# -- writing and reading ---------------------------------------------------------------------------


def operand(code: Column, width: int) -> Column:
    """1 .. 2**width, so that no spelling is the plain one."""
    return (F.pmod(code, F.lit(1 << width)) + 1).cast("long")


def render(value: Column, family: str, code: Column, width: int) -> Column:
    """A number spelled so that it carries the code; null if the family cannot."""
    b, m = operand(code, width), 1 << width
    said = lambda *parts: F.concat(F.lit("("), *parts, F.lit(")"))
    text = lambda c: c.cast("string")
    if family == "add":
        out = said(text(value - b), F.lit(" + "), text(b))
    elif family == "sub":
        out = said(text(value + b), F.lit(" - "), text(b))
    elif family == "mul":
        d = F.try_element_at(F.filter(_divisors(value, m), lambda d: d % m == b % m), F.lit(1))
        out = said(text(F.floor(value / d).cast("long")), F.lit(" * "), text(d))
    elif family == "radix":
        digits = F.lower(F.hex(value))
        seen = lambda i: F.length(F.regexp_replace(F.substring(digits, i, F.length(digits)), "[0-9]", ""))
        one = lambda i: F.substring(digits, i, F.lit(1))
        bit = lambda i: F.floor(F.pmod(code, F.lit(m)) / F.pow(F.lit(2.0), (seen(i) - 1).cast("double"))).cast("long") % 2
        cased = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when((seen(i) <= width) & (bit(i) == 1), F.upper(one(i))).otherwise(one(i)))
        out = F.concat(F.lit("0x"), F.array_join(cased, ""))
    else:
        raise ValueError(f"{family} does not spell numbers")
    return F.when(supports(value, family, width), out)


def decode(text: Column, family: str, width: int) -> tuple[Column, Column]:
    """(value, code) of a spelling; null if it is not one of the family."""
    m = 1 << width
    if family in ("add", "sub", "mul"):
        sign = {"add": r"\+", "sub": "-", "mul": r"\*"}[family]
        shape = rf"^\s*\(\s*([0-9]{{1,18}})\s*{sign}\s*([0-9]{{1,18}})\s*\)\s*$"
        part = lambda k: F.regexp_extract(text, shape, k).try_cast("bigint")
        a, b = part(1), part(2)
        value = {"add": F.try_add(a, b), "sub": F.try_subtract(a, b), "mul": F.try_multiply(a, b)}[family]
        return value, F.pmod(b - 1, F.lit(m)).cast("int")
    if family == "radix":
        digits = F.regexp_extract(text, r"^\s*0[xX]([0-9a-fA-F]{1,15})\s*$", 1)
        letters = F.regexp_replace(digits, "[0-9]", "")
        bits = F.translate(F.substring(letters, -width, width), "abcdefABCDEF", "000000111111")
        ok = F.length(letters) >= width
        return F.when(ok, F.conv(digits, 16, 10).try_cast("bigint")), F.when(ok, F.conv(bits, 2, 10).cast("int"))
    raise ValueError(f"{family} does not spell numbers")


def render_string(inner: Column, family: str, code: Column, width: int, quote: str = '"') -> Column:
    """A string literal spelled so that it carries the code, without a look at whether it can."""
    k = operand(code, width).cast("int")
    q, head, tail = F.lit(quote), F.left(inner, k), F.substring(inner, k + 1, F.length(inner))
    if family in ("str-concat", "str-adjacent"):
        joiner = " + " if family == "str-concat" else " "
        return F.concat(F.lit("("), q, head, q, F.lit(joiner), q, tail, q, F.lit(")"))
    if family == "str-escape":
        one = lambda i: F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(F.ascii(F.substring(inner, i, F.lit(1))))), 2, "0"))
        return F.concat(q, F.array_join(F.transform(F.sequence(F.lit(1), k), one), ""), tail, q)
    raise ValueError(f"{family} does not spell strings")


def decode_string(text: Column, family: str, width: int, quote: str = '"') -> tuple[Column, Column]:
    """(inner text, code) of a spelling with one kind of quote; null if it is not one of the family."""
    m, q = 1 << width, quote
    body = rf"([^{q}\\\n\r]+)"
    if family in ("str-concat", "str-adjacent"):
        joiner = r"\s*\+\s*" if family == "str-concat" else r"[ \t]\s*"
        shape = rf"^\s*\(\s*{q}{body}{q}{joiner}{q}{body}{q}\s*\)\s*$"
        left, right = F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2)
        ok = F.length(left) > 0
        return F.when(ok, F.concat(left, right)), F.when(ok, F.pmod(F.length(left) - 1, F.lit(m)))
    if family == "str-escape":
        shape = rf"^\s*{q}((?:\\x[0-9a-fA-F]{{2}})+)([^{q}\\\n\r]*){q}\s*$"
        coded, tail = F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2)
        count = (F.length(coded) / 4).cast("int")
        plain = F.transform(F.sequence(F.lit(1), count), lambda i: F.char(F.conv(F.substring(coded, i * 4 - 1, F.lit(2)), 16, 10).cast("int")))
        ok = count > 0
        return F.when(ok, F.concat(F.array_join(plain, ""), tail)), F.when(ok, F.pmod(count - 1, F.lit(m)))
    raise ValueError(f"{family} does not spell strings")
