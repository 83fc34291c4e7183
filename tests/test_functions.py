"""Functions against plain Python, round trips, and published vectors."""

import datetime
import hashlib
import hmac
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelight.functions import keys as K
from tracelight.functions import literals as L
from tracelight.functions import signing
from tracelight.functions import text as T
from tracelight.operators import grade as G
from tracelight.operators import lexical as X
from tracelight.operators import source_code as S
from tracelight.operators import transforms
from tracelight.sources.documents import DocumentError, canonical_json, is_canonical, is_signed, normalized_keys, signed, strict_json


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_keyed_digest_equals_the_library(spark):
    rng = random.Random(1)
    for size in (5, 32, 64, 100):
        key = rng.randbytes(size)
        rows = [(bytearray(rng.randbytes(rng.randint(0, 90))),) for _ in range(20)]
        for (m, got) in values(spark, rows, "m binary", "m", K.hmac_sha256(key, F.col("m"))):
            assert bytes(got) == hmac.new(key, bytes(m), hashlib.sha256).digest()


def test_framing_is_the_same_on_both_sides(spark):
    rows = [(bytearray(b"ab"), bytearray(b"")), (bytearray(b"a"), bytearray(b"b"))]
    got = values(spark, rows, "a binary, b binary", "a", "b", K.framed("site", F.col("a"), F.col("b")))
    assert [bytes(x) for *_, x in got] == [K.framed_bytes("site", bytes(a), bytes(b)) for a, b, _ in got]
    assert len({bytes(x) for *_, x in got}) == 2


def test_numbers_of_digests(spark):
    rows = [(bytearray(random.Random(i).randbytes(32)),) for i in range(20)]
    for d, k, low, b32 in values(spark, rows, "d binary", "d", K.index_of(F.col("d"), 7), K.low_bits(F.col("d"), 5), K.base32_lower(F.col("d"), 10)):
        import base64

        assert k == int.from_bytes(bytes(d), "big") % 7 and low == int.from_bytes(bytes(d)[:4], "big") & 31
        assert b32 == base64.b32encode(bytes(d)[:10]).decode().lower().rstrip("=")


def test_signature_vectors():
    # RFC 8032, section 7.1, tests 1 and 2
    one = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert signing.public_key(one).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    two = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    assert signing.sign(two, b"\x72").hex().startswith("92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da")
    key = signing.public_key(two)
    good = signing.sign(two, b"text")
    assert signing.verify(key, b"text", good) and not signing.verify(key, b"texT", good)
    assert not signing.verify(key, b"text", good[:-1] + b"\xff") and not signing.verify(b"", b"text", good)


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=6), x, max_size=4), max_leaves=12))
@settings(max_examples=150, deadline=None)
def test_canonical_json(value):
    data = canonical_json(value)
    assert is_canonical(data) and canonical_json(normalized_keys(value)) is not None


def test_documents():
    with pytest.raises(DocumentError):
        canonical_json({"a": [1.5]})
    assert not is_canonical(b'{"b":1, "a":2}') and not is_canonical(b"{")
    seed = bytes(32)
    doc = signed({"schema": "x-1", "n": 3}, seed)
    assert is_signed(doc, signing.public_key(seed)) and not is_signed(doc | {"n": 4}, signing.public_key(seed))
    assert strict_json('{"schema":"x-1","n":3}', "x-1", {"n": int})["n"] == 3
    for bad in ("[", '{"schema":"y-1","n":3}', '{"schema":"x-1"}', '{"schema":"x-1","n":3,"m":1}', '{"schema":"x-1","n":true}'):
        with pytest.raises(DocumentError):
            strict_json(bad, "x-1", {"n": int})


# -- literals --------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [2, 4, 6])
def test_numbers_carry_every_code(spark, width):
    numbers = [1, 17, 100, 4097, 5040, 720720, 1234567, 48879, 0xDEADBEEF, 0xABCDEFABCD, 2**40 + 1]
    rows = [(v, c) for v in numbers for c in range(1 << width)]
    df = spark.createDataFrame(rows, "v long, c int")
    for family in ("add", "sub", "mul", "radix"):
        spelled = df.withColumn("t", L.render(F.col("v"), family, F.col("c"), width)).where("t is not null")
        value, code = L.decode(F.col("t"), family, width)
        got = spelled.select("v", "c", "t", value.alias("x"), code.alias("k")).collect()
        assert got or family == "mul"  # few numbers have a divisor of every residue
        assert all((r.v, r.c) == (r.x, r.k) and r.t != str(r.v) for r in got), family
        if family != "radix":
            assert all(eval(r.t) == r.v for r in got)
        whole = {}
        for r in got:
            whole.setdefault(r.v, set()).add(r.c)
        assert all(len(s) == 1 << width for s in whole.values())


@pytest.mark.parametrize("width", [2, 3, 4, 5, 6, 7, 8])
def test_products_equal_a_plain_search(spark, width):
    m, rng = 1 << width, random.Random(width)
    whole = math.lcm(*range(1, 41)) // 3  # near 2**50
    numbers = [0, 1, 2, m, 12, 720720 * m, whole, *(5040 * m * rng.randrange(1, 2**40) for _ in range(60)), *(m * rng.randrange(1, 4000) for _ in range(60))]
    numbers += [whole // d * k for d in (1, 2, 3, 5) for k in (16, 48, 210, 1001)]

    def covered(v):
        pairs = [(d, v // d) for d in range(2, 8 * m + 1) if d <= v // 2 and v % d == 0]
        return len({x % m for p in pairs for x in p if 2 <= x <= v // 2}) == m

    numbers = [v for v in numbers if v < 2**63 - m]
    got = dict(values(spark, [(v,) for v in numbers], "v long", "v", L.supports(F.col("v"), "mul", width, L.DIALECTS["python"])))
    assert got == {v: covered(v) for v in numbers}
    assert width > 6 or any(v > 2**53 for v in got if got[v])


def test_strings_carry_every_code(spark):
    texts = ["the quick brown fox jumps over", "ünïcode letters are here too", "short"]
    df = spark.createDataFrame([(t, c, q) for t in texts for c in range(8) for q in "\"'"], "s string, c int, q string")
    for family in ("str-concat", "str-adjacent", "str-escape"):
        for quote in "\"'":
            own = df.where(F.col("q") == quote).where(L.string_supports(F.col("s"), family, 3, L.DIALECTS["python"]))
            own = own.withColumn("t", L.render_string(F.col("s"), family, F.col("c"), 3, quote))
            value, code = L.decode_string(F.col("t"), family, 3, quote)
            got = own.select("s", "c", "t", value.alias("x"), code.alias("k")).collect()
            assert got and all((r.s, r.c) == (r.x, r.k) and eval(r.t) == r.s for r in got), family


def test_literals_that_are_refused(spark):
    texts = ["", "12", "0x1F", "0b101", "0o17", "1_000", "1.5", "12n", "x", "012", "1e5", "0x", "0xZZ", "99999999999999999999", "9007199254740993", " 7 "]
    got = dict((t, (v, r)) for t, v, r in values(spark, [(t,) for t in texts], "t string", "t", L.integer_value(F.col("t")), L.integer_refusal(F.col("t"))))
    assert [got[t][0] for t in ("12", "0x1F", "0b101", "0o17", " 7 ")] == [12, 31, 5, 15, 7]
    assert got["1_000"][1] == "digit-separator" and got["1.5"][1] == got["1e5"][1] == "floating-point" and got["12n"][1] == "big-int"
    assert got["012"][1] == "ambiguous-radix" and got["x"][1] == got[""][1] == got["0x"][1] == got["0xZZ"][1] == "not-a-literal"
    assert got["99999999999999999999"][1] == "out-of-range" and got["9007199254740993"][1] == "not-exactly-representable"
    assert values(spark, [("9007199254740993",)], "t string", L.integer_value(F.col("t"), L.DIALECTS["python"])) == [(9007199254740993,)]


# -- grading ---------------------------------------------------------------------------------------


def test_poisson_tail(spark):
    rows = [(m / 8, n) for m in range(0, 40) for n in range(0, 14)]
    for m, n, got in values(spark, rows, "m double, n int", "m", "n", G.poisson_tail(F.col("m"), F.col("n"))):
        want = 1.0 if n == 0 else 0.0 if m == 0 else 1 - sum(math.exp(-m) * m**i / math.factorial(i) for i in range(n))
        assert abs(got - max(0.0, want)) < 1e-12
    (a,), (b,) = (values(spark, [(m, n)], "m double, n int", G.poisson_tail(F.col("m"), F.col("n")))[0] for m, n in ((0.125, 2), (0.5, 8)))
    assert round(a, 6) == 0.007191 and f"{b:.1e}" == "6.2e-08"


def test_ladder_and_verdicts(spark):
    cases = [(0, 0, 1.0, "NONE"), (1, 1, 1e-9, "WEAK"), (2, 1, 1e-9, "MODERATE"), (4, 1, 1e-9, "MODERATE"), (4, 2, 1e-9, "STRONG"), (6, 1, 1e-9, "STRONG"), (8, 3, 1e-9, "VERY_STRONG"), (8, 3, 6.2e-8, "STRONG"), (8, 3, 1e-4, "MODERATE"), (8, 3, 0.5, "WEAK")]
    got = values(spark, [c[:3] for c in cases], "f int, g int, p double", G.level_word(G.level_rank(F.col("f"), F.col("g"), F.lit(False), F.col("p"))))
    assert [x for (x,) in got] == [c[3] for c in cases]
    thirds = values(spark, [(1, 12), (4, 12), (8, 12), (0, 0)], "c int, t int", G.partial_level(F.col("c"), F.col("t")))
    assert [x for (x,) in thirds] == ["WEAK", "MODERATE", "STRONG", "NONE"]
    ((chance,),) = values(spark, [(16,)], "d int", G.site_chance(F.col("d"), 4))
    assert abs(chance - (1 - (15 / 16) ** 16)) < 1e-12


# -- text ------------------------------------------------------------------------------------------


def test_paths_and_text(spark):
    one = lambda f, *xs: [r[0] for r in values(spark, [(x,) for x in xs], "x string", f(F.col("x")))]
    assert one(T.canonical_relpath, "./a//b/./c", "a\\b", "") == ["a/b/c", "a/b", ""]
    assert one(T.lexical_normal, "a/../b", "../a", "a/b/../../../c", "x/./y") == ["b", "../a", "../c", "x/y"]
    assert one(T.newlines_to_lf, "a\r\nb\rc\n") == ["a\nb\nc\n"] and one(T.strip_bom, "\ufeffx\ufeff") == ["x\ufeff"]
    assert one(T.dominant_newline, "a\r\nb\r\nc\n", "a\r\nb\n", "") == ["crlf", "lf", "lf"]
    assert one(T.member_fault, "a/b", "../a", "/a", "C:/x", "") == [None, "parent", "absolute", "drive", "empty"]
    assert one(lambda c: T.hint(c, 240), "é" * 200, "x")[0].encode()[:-3] == ("é" * 120).encode()
    assert one(lambda c: T.wrapped(c, 10), "one two three fourteenletters x") == ["one two\nthree\nfourteenletters\nx"]
    assert one(lambda c: T.relabel(c, "/home/p/.store"), "/home/p/.store/public/x", "/else") == [".store/public/x", "/else"]
    assert one(T.display_path, "\\\\?\\C:\\x") == ["C:\\x"] and one(T.nfc, "e\u0301", None) == ["é", None]
    globs = ["**/node_modules/**", "*.map", "src/?.py"]
    assert one(lambda c: T.excluded(c, globs), "a/node_modules/x", "node_modules/x", "x.map", "a/x.map", "SRC/a.py", "src/ab.py") == [True, True, True, False, True, False]


def test_time_words(spark):
    rows = [(datetime.datetime(2024, 5, 6, 7, 8, 9, 123456),)]
    ((s,),) = values(spark, rows, "t timestamp", F.date_format(F.date_trunc("second", F.col("t")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    assert s == "2024-05-06T07:08:09Z"


# -- source code -----------------------------------------------------------------------------------

PYTHON = 'def f(a):\n    "doc"\n    x = a + 4096\n    return {"k": 77, 3: x}[a]\n\n\nprint(f"{1}", "some words here", b"x", r"y")\n'


def test_python_sites():
    a = S.analyse(PYTHON, "python")
    found = {s["original"] for s in S.sites(a)}
    assert found == {"4096", "77", '"some words here"'} and not a.degraded
    reasons = {w for *_, w in a.refusals}
    assert {"a statement of one string", "a key"} <= reasons
    assert S.analyse("def (", "python").degraded


def test_addresses_survive_renaming_and_respelling():
    get = lambda text, lit: next(S.addresses(S.analyse(text, "python"), i, i + len(lit))[0] for i in [text.index(lit)])
    plain = get(PYTHON, "4096")
    respelled = get(PYTHON.replace("4096", "(4090 + 6)"), "(4090 + 6)")
    assert plain == respelled
    renamed = get(PYTHON.replace("x", "xx"), "4096")
    assert plain[0] == renamed[0] and plain[2] != renamed[2]


@pytest.mark.parametrize("language", ["javascript", "python", "generic"])
@given(text=st.text(alphabet="ab1 2\n(){}[];=+*\"'\\/`.:,#é", max_size=80))
@settings(max_examples=80, deadline=None)
def test_any_text_is_analysed(language, text):
    a = S.analyse(text, language)
    for t, u in zip(a.tokens, a.tokens[1:]):
        assert t.start <= t.end <= u.end and t.start <= u.start
    for s in S.sites(a):
        assert text[s["start"] : s["end"]] == s["original"] and len(s["digests"]) == 4
    for start, end, n in S.windows(a):
        assert 0 <= start < end <= len(text) and 1 <= n <= 6


def test_deep_and_long_input():
    assert S.analyse("(" * 4000 + ")" * 4000, "python").tokens
    assert len(S.windows(S.analyse("(1 + 2) " * 9000, "generic"))) <= S.MOST_WINDOWS + 5


def test_token_stream(spark):
    df = spark.createDataFrame([(1, 'let x = f(3, "a b") + 0x1F; // é'), (2, ""), (3, None)], "id int, text string")
    got = [(r.token, r.kind) for r in X.tokens(df, "id").orderBy("id", "pos").collect()]
    assert ("let", "word") in got and ('"a b"', "string") in got and ("0x1F", "number") in got and ("(", "punct") in got and ("é", "word") in got


def test_spellings_of_a_secret():
    secret = b"\x01\xfe secret"
    assert secret.hex().encode() in transforms.encodings(secret) and len(transforms.encodings(secret)) >= 8


def test_sweep(spark):
    df = spark.createDataFrame([("a", bytearray(b"xx\x01\x02yy")), ("b", bytearray(b"none"))], "file string, content binary")
    assert [(r.file, r.needles) for r in transforms.sweep(df, [b"\x01\x02", b"zz"]).collect()] == [("a", [0])]


def test_addresses_are_digests_of_the_canonical_text():
    texts = {"python": "def f(a, b=3):\n    x = a + (1 + 2)\n    return [x, 'q', b, 5 * a]\n", "javascript": "function f(a) { const b = (7 + 1); return g(b, 'x y') - 0x1F; }\nlet c = [1, 2];\n"}
    for language, text in texts.items():
        a = S.analyse(text, language)
        spans = S.lone_literals(a) + S.windows(a) + [(i, j) for i in range(0, len(text), 3) for j in range(i + 1, min(len(text), i + 20))]
        for start, end, *_ in spans:
            digests, statement, scope = S.addresses(a, start, end)
            whole = (0, max(t.end for t in a.tokens) + 1)
            assert statement == S.tightest([s for s in a.statements if s[1] >= end], start, whole) and scope == S.tightest([s for s in a.scopes if s[1] >= end], start, whole)
            assert digests == [hashlib.sha256(S.canonical(a.within(*span), abstract, (start, end)).encode()).digest() for abstract in (True, False) for span in (statement, scope)]


def test_caps_of_a_file_are_said():
    a = S.analyse("const t = [" + "1, " * 21_000 + "9];\nconst z = (1 + 2);", "javascript")
    assert len(S.lone_literals(a)) == 21_003 and len(S.windows(a)) == S.MOST_WINDOWS and a.capped == {"windows"}
    a = S.analyse("x = 1;\n" * (S.MOST_SITES + 1), "javascript")
    assert len(S.sites(a)) == S.MOST_SITES and a.capped == {"sites"} and a.refusals[-1][2] == "site-limit"
    a = S.analyse("const z = (1 + 2);", "javascript")
    assert S.windows(a) and S.sites(a) and not a.capped


def test_all_windows_of_a_long_text(spark):
    df = spark.createDataFrame([(1, "1 + " * 11_000 + "1")], "id int, text string")
    got = X.form_windows(X.tokens(df, "id"), "id").groupBy("n").count().collect()
    assert {r.n: r["count"] for r in got} == {3: 11_000, 5: 10_999}
