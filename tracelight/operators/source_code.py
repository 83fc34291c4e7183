"""Source files as tokens, spans, literal sites and the places they stand at.

One pure Python analyser serves every caller; Spark runs it inside ``mapInPandas``.  Python files are
read with the standard tokenizer and syntax tree, so statements, scopes and unsafe positions are exact.
JavaScript, TypeScript and files of unknown languages are read by a scanner: a statement ends at ``;``
or at a brace, a scope is the innermost pair of braces.  Positions are character offsets.

A *site* is a literal that may be spelled in another way.  It is addressed by four digests of the text
around it, from renaming-proof to exact: the statement and the scope, each abstract and exact, with the
site itself hidden.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

MOST_SITES = 4_000
MOST_REFUSALS = 256
MOST_WINDOWS = 20_000
MOST_FORM_TOKENS = 6
LONGEST_LITERAL = 240
BLOCK = 4_096

# Words that are no identifiers.
KEYWORDS = {
    "python": frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()),
    "javascript": frozenset("async await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof let new null of return static super switch this throw true try typeof undefined var void while with yield".split()),
}
KEYWORDS["typescript"] = KEYWORDS["javascript"] | frozenset("abstract as declare enum implements interface keyof namespace private protected public readonly type".split())
KEYWORDS["generic"] = frozenset()

_SCANNER = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<template>`(?:\\.|[^`\\])*`)"""
    r"""|(?P<number>(?:0[xXoObB])?[0-9][0-9A-Za-z_.]*)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<operator>[+\-*/%=<>!&|^~?]+)|(?P<punct>[^\s\w])""",
    re.S,
)


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Analysis:
    language: str
    tokens: list[Token] = field(default_factory=list)
    statements: list[tuple[int, int]] = field(default_factory=list)
    scopes: list[tuple[int, int]] = field(default_factory=list)
    refusals: list[tuple[int, int, str]] = field(default_factory=list)
    unsafe: dict[int, str] = field(default_factory=dict)  # by start of the literal
    degraded: bool = False

    def __post_init__(self):
        self._starts: list[int] | None = None
        self._blocks: dict[str, dict[int, list[tuple[int, int]]] | None] = {}
        self._bodies: dict[tuple, tuple[list[Token], list[int], list[int], bytes]] = {}
        self.capped: set[str] = set()  # what stopped at its cap: "sites", "windows"

    def near(self, kind: str, at: int) -> list[tuple[int, int]]:
        """``statements`` or ``scopes`` of which some may hold a position, in their order; all that do are in it."""
        spans = getattr(self, kind)
        if kind not in self._blocks:
            runs = [range(a // BLOCK, max(a, b - 1) // BLOCK + 1) for a, b in spans]
            blocks = None
            if sum(map(len, runs)) <= 8 * len(spans) + 50_000:  # nested deep, they are looked through one by one
                blocks = {}
                for span, run in zip(spans, runs):
                    for i in run:
                        blocks.setdefault(i, []).append(span)
            self._blocks[kind] = blocks
        blocks = self._blocks[kind]
        return spans if blocks is None else blocks.get(at // BLOCK, [])

    def within(self, start: int, end: int) -> list[Token]:
        if self._starts is None:
            self._starts = [t.start for t in self.tokens]
        lo = bisect_right(self._starts, start - 1)
        hi = bisect_right(self._starts, end - 1)
        return [t for t in self.tokens[lo:hi] if t.end <= end]


def tightest(spans: list[tuple[int, int]], at: int, otherwise: tuple[int, int]) -> tuple[int, int]:
    """The shortest span around a position; the first of equals."""
    around = [s for s in spans if s[0] <= at < s[1]]
    return min(around, key=lambda s: s[1] - s[0]) if around else otherwise


# -- reading ---------------------------------------------------------------------------------------


def _python(text: str) -> Analysis:
    lines = [0]
    for line in text.splitlines(keepends=True):
        lines.append(lines[-1] + len(line))
    at = lambda row, col: lines[row - 1] + col
    out = Analysis("python")
    tree = ast.parse(text)
    names = {tokenize.NUMBER: "number", tokenize.STRING: "string", tokenize.OP: "operator"}
    skipped = {tokenize.COMMENT, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING}
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type in skipped:
            continue
        start, end = at(*t.start), at(*t.end)
        if t.type == tokenize.NEWLINE:
            out.tokens.append(Token("break", "\n", start, start))
        elif t.type == tokenize.NAME:
            out.tokens.append(Token("keyword" if t.string in KEYWORDS["python"] else "word", t.string, start, end))
        elif t.type in names:
            kind = "punct" if t.string in "()[]{},:;." else names[t.type]
            out.tokens.append(Token(kind, t.string, start, end))
        else:
            out.tokens.append(Token("other", t.string, start, end))
    raw = [line.encode() for line in text.splitlines(keepends=True)] or [b""]
    byte_at = lambda row, col: lines[row - 1] + len(raw[row - 1][:col].decode())
    span = lambda n: (byte_at(n.lineno, n.col_offset), byte_at(n.end_lineno, n.end_col_offset))
    for node in ast.walk(tree):
        if isinstance(node, ast.stmt):
            out.statements.append(span(node))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            out.scopes.append(span(node))
        if isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
            out.unsafe[span(node.value)[0]] = "a statement of one string"
        if isinstance(node, ast.Dict):
            for key in node.keys:
                if isinstance(key, ast.Constant):
                    out.unsafe[span(key)[0]] = "a key"
        if isinstance(node, ast.pattern):
            for inner in ast.walk(node):
                if isinstance(inner, ast.Constant):
                    out.unsafe[span(inner)[0]] = "a pattern"
        if isinstance(node, (ast.JoinedStr, ast.FormattedValue)):
            for inner in ast.walk(node):
                if isinstance(inner, ast.Constant):
                    out.unsafe[span(inner)[0]] = "part of a template"
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("__import__",):
            for inner in node.args:
                out.unsafe[span(inner)[0]] = "a module name"
        for note in (getattr(node, "annotation", None), getattr(node, "returns", None)):
            if isinstance(note, ast.AST):
                for inner in ast.walk(note):
                    if isinstance(inner, ast.Constant):
                        out.unsafe[span(inner)[0]] = "a type"
    # strings that stand side by side are one literal
    for a, b in zip(out.tokens, out.tokens[1:]):
        if a.kind == b.kind == "string":
            out.unsafe[a.start] = out.unsafe[b.start] = "one of several adjacent strings"
    return out


def _scanned(text: str, language: str) -> Analysis:
    out = Analysis(language)
    words = KEYWORDS.get(language, KEYWORDS["generic"])
    for m in _SCANNER.finditer(text):
        kind = m.lastgroup
        if kind == "comment":
            continue
        if kind == "word" and m.group() in words:
            kind = "keyword"
        out.tokens.append(Token(kind, m.group(), m.start(), m.end()))
    opened, begin = [], out.tokens[0].start if out.tokens else 0
    for i, t in enumerate(out.tokens):
        following = out.tokens[i + 1].start if i + 1 < len(out.tokens) else len(text)
        if t.text == "{":
            opened.append(t.start)
        if t.text in (";", "{", "}"):
            out.statements.append((begin, t.end))
            begin = following
        if t.text == "}" and opened:
            out.scopes.append((opened.pop(), t.end))
        before = out.tokens[i - 1] if i else None
        after = out.tokens[i + 1] if i + 1 < len(out.tokens) else None
        if t.kind in ("number", "string"):
            if before and before.text in ("import", "from", "require") or before and before.text == "(" and i > 1 and out.tokens[i - 2].text in ("require", "import"):
                out.unsafe[t.start] = "a module name"
            elif after and after.text == ":" and (not before or before.text in ("{", ",", "case")):
                out.unsafe[t.start] = "a key"
            elif t.kind == "string" and (not before or before.text in (";", "{", "}")) and (not after or after.text in (";", "}")):
                out.unsafe[t.start] = "a statement of one string"
            elif before and before.text in (".", "#", ":") and t.kind == "number":
                out.unsafe[t.start] = "part of a larger token"
            elif before and before.text == "=" and i > 1 and out.tokens[i - 2].text == "type":
                out.unsafe[t.start] = "a type"
    if out.tokens and begin < out.tokens[-1].end:
        out.statements.append((begin, out.tokens[-1].end))
    return out


def analyse(text: str, language: str) -> Analysis:
    if language == "python":
        try:
            return _python(text)
        except (SyntaxError, ValueError, tokenize.TokenError, RecursionError, IndexError, MemoryError):
            out = _scanned(text, "generic")
            out.degraded = True
            return out
    return _scanned(text, language)


# -- canonical text and addresses ------------------------------------------------------------------


def _escaped(value: str) -> str:
    return value.replace("\\", "\\\\").replace(" ", "_").replace("<", "\\<").replace(">", "\\>")


def canonical(tokens: list[Token], abstract: bool, hidden: tuple[int, int]) -> str:
    """Tokens in one line, with what stands in ``hidden`` as one mark."""
    out, names, marked = [], {}, False
    for t in tokens:
        if t.start >= hidden[0] and t.end <= hidden[1] and t.end > t.start:
            if not marked:
                out.append("<site>")
                marked = True
        elif abstract and t.kind == "word":
            out.append(f"#l{names.setdefault(t.text, len(names))}")
        elif abstract and t.kind in ("number", "string"):
            out.append(f"<{t.kind}>")
        elif t.kind == "break":
            out.append("<nl>")
        else:
            out.append(_escaped(t.text))
    return " ".join(out)


def _digest(analysis: Analysis, abstract: bool, span: tuple[int, int], hidden: tuple[int, int]) -> bytes:
    """SHA-256 of ``canonical``, from text that is put together once for a span."""
    body = analysis._bodies.get((abstract, span))
    if body is None:
        if len(analysis._bodies) >= 64:
            analysis._bodies.clear()
        tokens = analysis.within(*span)
        names: dict[str, int] = {}
        pieces, offsets, at = [], [], 0
        for t in tokens:
            piece = f"#l{names.setdefault(t.text, len(names))}" if abstract and t.kind == "word" else canonical([t], abstract, (-1, -1))
            pieces.append(piece.encode())
            offsets.append(at)
            at += len(pieces[-1]) + 1
        body = analysis._bodies[abstract, span] = tokens, [t.start for t in tokens], offsets, b" ".join(pieces)
    tokens, starts, offsets, whole = body
    i = j = bisect_left(starts, hidden[0])
    while j < len(tokens) and starts[j] < hidden[1]:
        t = tokens[j]
        if t.end > hidden[1] or t.end <= t.start or t.kind == "word":  # not one run, or it would change the names
            return hashlib.sha256(canonical(tokens, abstract, hidden).encode()).digest()
        j += 1
    view = memoryview(whole)
    if i == j:
        return hashlib.sha256(view).digest()
    out = hashlib.sha256(view[: offsets[i]])
    out.update(b"<site>")
    if j < len(tokens):
        out.update(b" ")
        out.update(view[offsets[j] :])
    return out.digest()


def addresses(analysis: Analysis, start: int, end: int) -> tuple[list[bytes], tuple[int, int], tuple[int, int]]:
    """Four digests (statement and scope, abstract; statement and scope, exact) and both spans."""
    whole = (0, max((t.end for t in analysis.tokens), default=0) + 1)
    statement = tightest([s for s in analysis.near("statements", start) if s[1] >= end], start, whole)
    scope = tightest([s for s in analysis.near("scopes", start) if s[1] >= end], start, whole)
    out = []
    for abstract in (True, False):
        for span in (statement, scope):
            out.append(_digest(analysis, abstract, span, (start, end)))
    return out, statement, scope


def literal_kind(token: Token) -> str | None:
    """``integer`` or ``string`` for a literal that can be respelled, else None."""
    if token.kind == "number" and re.fullmatch(r"0|[1-9][0-9]{0,14}|0[xX][0-9a-fA-F]{1,12}", token.text):
        return "integer"
    if token.kind == "string" and re.fullmatch(r"\"[^\"\\\n\r]+\"|'[^'\\\n\r]+'", token.text) and token.text[:3] not in ('"""', "'''"):
        return "string"
    return None


def sites(analysis: Analysis) -> list[dict]:
    """Literals that may be respelled, with what surrounds them.

    At most ``MOST_SITES`` of a file; with more, ``analysis.capped`` has ``sites``.
    """
    out = []
    for t in analysis.tokens:
        if t.kind not in ("number", "string"):
            continue
        kind, why = literal_kind(t), analysis.unsafe.get(t.start)
        if kind and not why and len(t.text.encode()) <= LONGEST_LITERAL:
            if len(out) < MOST_SITES:
                digests, statement, scope = addresses(analysis, t.start, t.end)
                out.append({"start": t.start, "end": t.end, "kind": kind, "original": t.text, "digests": digests, "statement": statement, "scope": scope})
                continue
            analysis.capped.add("sites")
            why = "site-limit"
        if len(analysis.refusals) < MOST_REFUSALS:
            analysis.refusals.append((t.start, t.end, why or "not-a-plain-literal"))
    return out


def lone_literals(analysis: Analysis) -> list[tuple[int, int, int]]:
    """(start, end, 1) of every literal."""
    return [(t.start, t.end, 1) for t in analysis.tokens if t.kind in ("number", "string")]


def windows(analysis: Analysis) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of balanced runs of two to six tokens that could spell a literal.

    At most ``MOST_WINDOWS`` of a file; with more, ``analysis.capped`` has ``windows``.
    """
    tokens, out = analysis.tokens, set()
    material = ("number", "string", "operator", "punct")
    literal = ("number", "string")
    for i, t in enumerate(tokens):
        if t.kind not in literal and t.text not in "([{":
            continue
        depth = 0
        for j in range(i, min(i + MOST_FORM_TOKENS, len(tokens))):
            u = tokens[j]
            if u.kind not in material:
                break
            depth += (u.text in ("(", "[", "{")) - (u.text in (")", "]", "}"))
            if depth < 0:
                break
            if j > i and depth == 0 and (u.kind in literal or u.text in (")", "]", "}")):
                if len(out) >= MOST_WINDOWS:
                    analysis.capped.add("windows")
                    return sorted(out)
                out.add((t.start, u.end, j - i + 1))
    return sorted(out)
