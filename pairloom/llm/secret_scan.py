"""Secrets in source, configuration and prose, with positions in code points.

Base spans come from three patterns: literals behind a secret word, access keys and hexadecimal runs.
The method adds what an assignment-aware lexer finds: around every assignment operator it reads a
name and an expression (quoted strings with escapes, bare configuration values, names, ``+``) and
keeps a table of names and what they hold. A value is a node that refers to its literals and to the
values it was made of, never a copy of them; what the score needs of it (length, counts of
characters, blanks, placeholders) is added up from its parts. Literals are scored by the sensitive
names that they reach: where a value scores under its name, its literals are marked, each node once.

Null is empty text. Texts without an operator or a key word are passed over by plain search. A text
is handled in one pass and without a limit on its length; equal rows get equal results.
"""

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Order of kinds at equal starts; "named" holds what the lexer adds.
KINDS = ("assign", "access", "hex", "named")
MARK = "[SECRET]"
THRESHOLD = 0.5
# Names of this weight also make short quoted literals, and such with blanks, secrets.
STRONG = 1.0
# Counts of a value beyond this are scaled down together: x = x + x doubles without an end.
_MOST = 1e12

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
# Runs are maximal, so a lower bound on their length selects the same matches as a later check.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WORDS = (b"passw", b"secret", b"token", b"api")

_OPERATOR = re.compile(r":=|=>|[:=]")
_NAME_END = re.compile(r"""[\w$\-.\])"'`]""")
_STRING = re.compile(r"""[rbuRBU]{0,2}("{3}(?:[^\\]|\\.)*?"{3}|'{3}(?:[^\\]|\\.)*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)""", re.DOTALL)
_IDENT = re.compile(r"\$?\{?([A-Za-z_][\w.\-]*)\}?")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>#]+""")
_PLUS = re.compile(r"\s*(?:\+|\.\.|&)\s*(?=[\"'`A-Za-z_$])")
_INSIDE = re.compile(r"\$\{([A-Za-z_]\w*)\}")
_SPACES = re.compile(r"[ \t]*")
_NAME_CHAR = re.compile(r"[\w$\-.]")

_SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9,
    "apikey": 0.95, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 0.95,
    "secretkey": 1.0, "auth": 0.7, "authorization": 0.8, "bearer": 0.8, "signature": 0.6, "salt": 0.6,
    "cert": 0.5, "key": 0.55,
}
_PLACEHOLDER = re.compile(r"<.*>|\*+|\$\{.*|x{3,}|none|null|true|false|undefined", re.IGNORECASE | re.DOTALL)
# Words that make a value a placeholder where they are a whole part of it.
_PLACEHOLDERS = frozenset(["example", "changeme", "placeholder", "dummy", "todo", "redacted", "xxx", "xxxx", "your"])
_WORD = re.compile(r"[A-Za-z]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_]+")


class Span(NamedTuple):
    start: int
    order: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.order]}:{self.start}:{self.end}"


class Value:
    """What an expression or a name holds: a literal's place in the text, or the values it is made of."""

    __slots__ = ("blank", "counts", "literal", "marked", "parts", "placeholder", "quoted", "size")

    def __init__(self, text: str, literal: tuple[int, int] | None, parts: tuple["Value", ...] = (), quoted: bool = False) -> None:
        self.literal, self.parts, self.marked = literal, parts, False
        # Characters fall into 256 counters and four kinds, so a value has a bounded size.
        self.counts: dict[int, float] = {}
        for c, n in Counter(text).items():
            key = ord(c) & 255 | (256 if c.islower() else 512 if c.isupper() else 1024 if c.isdigit() else 0 if c.isalnum() else 2048)
            self.counts[key] = self.counts.get(key, 0) + n
        self.size = float(len(text))
        self.blank = any(map(str.isspace, text))
        self.placeholder = bool(text) and _is_placeholder(text)
        self.quoted = quoted or any(p.quoted for p in parts)
        for p in parts:
            self.size += p.size
            self.blank |= p.blank
            self.placeholder |= p.placeholder
            for key, n in p.counts.items():
                self.counts[key] = self.counts.get(key, 0) + n
        if self.size > _MOST:
            self.counts = {k: n / self.size * _MOST for k, n in self.counts.items()}
            self.size = _MOST

    def weight(self, name: float = 0.0) -> float:
        """Between 0 and 1 by length, variety of characters and entropy; 0 for placeholders and prose.

        A quoted value under a strong name may be shorter, if it has more than letters, or hold blanks.
        """
        strong = name >= STRONG and self.quoted
        kinds = sum(any(k & kind for k in self.counts) for kind in (256, 512, 1024, 2048))
        if self.placeholder or not self.size or (self.blank and not (strong and self.size >= 12)):
            return 0.0
        if self.size < 8 and not (strong and self.size >= 6 and kinds > 1):
            return 0.0
        bits = -sum(n / self.size * math.log2(n / self.size) for n in self.counts.values())
        return min(1.0, bits / 3.5) * min(1.0, 0.4 + 0.2 * kinds + 0.02 * max(self.size - 8, 0))

    def mark(self, into: set[tuple[int, int]]) -> None:
        """Add the literals that the value was made of; a value that was marked before is passed over."""
        open_ = [self]
        while open_:
            value = open_.pop()
            if value.marked:
                continue
            value.marked = True
            if value.literal:
                into.add(value.literal)
            open_.extend(p for p in value.parts if not p.marked)


def _is_placeholder(text: str) -> bool:
    if _PLACEHOLDER.fullmatch(text):
        return True
    words = [w.lower() for w in _WORD.findall(text)]
    return "change_me" in text.lower() or (not any(map(str.isspace, text)) and not _PLACEHOLDERS.isdisjoint(words))


def name_weight(name: str) -> float:
    """Sensitivity of a target name: its strongest part, or two adjacent parts together."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((_SENSITIVE.get(p, 0.0) for p in (*parts, *joined)), default=0.0)


def literal_weight(value: str, name: float = 0.0, quoted: bool = False) -> float:
    """The weight of a text under a name of the given sensitivity."""
    return Value(value, None, quoted=quoted).weight(name)


def _name_before(text: str, at: int) -> str:
    """The assignment target that ends before position ``at``, without quotes; '' if there is none."""
    while at > 0 and text[at - 1] in " \t":
        at -= 1
    if at == 0 or not _NAME_END.match(text[at - 1]):
        return ""
    if text[at - 1] == "]":
        at -= 1
    quote = text[at - 1] if at and text[at - 1] in "\"'`" else ""
    end = at - 1 if quote else at
    start = end
    while start > 0 and _NAME_CHAR.match(text[start - 1]):
        start -= 1
    if quote and (start == 0 or text[start - 1] != quote):
        return ""
    return text[start:end].strip("-.")


def _term(text: str, at: int, held: dict[str, Value]) -> tuple[Value, int] | None:
    """The string, name or bare value at ``at``, and where it ends."""
    if m := _STRING.match(text, at):
        raw = m.group(1)
        cut = 3 if raw[:3] in ('"""', "'''") else 1
        start, end = m.start(1) + cut, m.end(1) - cut
        body = text[start:end]
        named = [r for r in _INSIDE.finditer(body) if r[1] in held] if "${" in body else []
        own, last = [], 0
        for r in named:
            own.append(body[last : r.start()])
            last = r.end()
        own.append(body[last:])
        literal = (start, end) if end > start else None
        return Value("".join(own), literal, tuple(held[r[1]] for r in named), quoted=True), m.end()
    if (m := _IDENT.match(text, at)) and m.group(1) in held and not _BARE.match(text, m.end()):
        return held[m.group(1)], m.end()
    if m := _BARE.match(text, at):
        return Value(m.group(), m.span()), m.end()
    return None


def assignments(text: str) -> list[tuple[str, Value]]:
    """Name and value of every assignment, in order of the text.

    The operators within a run of bare characters, as in name=a:b, are assignments too, each with
    what follows it in the run. Such a run is read once, from its end.
    """
    held: dict[str, Value] = {}
    found = []
    at = 0
    while m := _OPERATOR.search(text, at):
        at = m.end()
        if (m.group() == "=" and text[at : at + 1] == "=") or text[m.start() - 1 : m.start()] in tuple("=!<>:"):
            at += text[at : at + 1] == "="
            continue
        name = _name_before(text, m.start())
        if not name or text[at : at + 2] == "//":
            continue
        begin = _SPACES.match(text, at).end()
        parts, end = [], begin
        while term := _term(text, end, held):
            value, end = term
            parts.append(value)
            if not (plus := _PLUS.match(text, end)):
                break
            end = plus.end()
        if not any(p.literal or p.parts for p in parts):
            continue
        value = parts[0] if len(parts) == 1 else Value("", None, tuple(parts))
        found.append((name, value))
        held[name] = value
        if text[begin : begin + 1] in "\"'`":
            at = max(at, end)
        elif parts[0].literal and parts[0].literal[0] == begin:
            at = _inner(text, *parts[0].literal, held, found)
    return found


def _inner(text: str, start: int, end: int, held: dict[str, Value], found: list[tuple[str, Value]]) -> int:
    """The assignments within the bare run from ``start`` to ``end``; where the text is read on.

    Their values are the ends of the run. Each is made of what stands before the next one's value
    and of that one, so that the run's characters are counted once.
    """
    places = []
    at = start
    while (m := _OPERATOR.search(text, at, end)) and m.end() < end:
        at = m.end()
        if (m.group() == "=" and text[at : at + 1] == "=") or text[m.start() - 1 : m.start()] in tuple("=!<>:"):
            at += text[at : at + 1] == "="
            continue
        name = _name_before(text, m.start())
        if name and text[at : at + 2] != "//" and m.start() > start:
            places.append((name, m.end()))
    value, later = None, []
    upto = end
    for name, begin in reversed(places):
        tail = Value(text[begin:upto], None, (value,) if value else ())
        tail.literal, tail.parts = (begin, end), ()
        value, upto = tail, begin
        later.append((name, tail))
    for name, tail in reversed(later):
        found.append((name, tail))
        held[name] = tail
    # An operator that ends the run takes its value from behind it.
    last = _OPERATOR.search(text, at, end)
    return last.start() if last else at


def base_spans(text: str) -> list[Span]:
    spans = []
    low = text.encode().lower()
    if any(w in low for w in _WORDS):
        spans += [Span(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if b"akia" in low:
        spans += [Span(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [Span(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Literals that reach a sensitive name and lie in no base span."""
    if "=" not in text and ":" not in text:
        return []
    out: set[tuple[int, int]] = set()
    for name, value in assignments(text):
        weight = name_weight(name)
        if weight and weight * value.weight(weight) >= THRESHOLD:
            value.mark(out)
    starts = [b.start for b in base]
    reach = list(accumulate((b.end for b in base), max))
    inside = lambda s, e: (i := bisect_right(starts, s)) > 0 and e <= reach[i - 1]
    return [Span(s, 3, e) for s, e in sorted(out) if not inside(s, e)]


def scan(text: str | None) -> dict:
    text = text or ""
    base = base_spans(text)
    counts = Counter(s.order for s in base)
    every = sorted([*base, *added_spans(text, base)])
    return {
        "n_assign": counts[0],
        "n_access": counts[1],
        "n_hex": counts[2],
        "base_sha256": hashlib.sha256(",".join(map(str, base)).encode()).hexdigest(),
        "spans": ",".join(map(str, every)),
    }


def redact(text: str | None, mark: str = MARK) -> str | None:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    if text is None:
        return None
    base = base_spans(text)
    out, at = [], 0
    for span in sorted([*base, *added_spans(text, base)]):
        if span.start >= at:
            out += [text[at : span.start], mark]
        at = max(at, span.end)
    return "".join([*out, text[at:]])


_RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")]
    + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
)


@F.arrow_udf(_RESULT)
def _scan(texts: pa.Array) -> pa.Array:
    rows = [scan(t) for t in texts.to_pylist()]
    kinds = [pa.int64()] * 3 + [pa.string()] * 2
    names = _RESULT.names
    return pa.StructArray.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)


@F.arrow_udf(T.StringType())
def _redact(texts: pa.Array) -> pa.Array:
    return pa.array([redact(t) for t in texts.to_pylist()], pa.string())


def secrets(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts per kind, digest of the base spans and all spans of every document."""
    return docs.select("doc_id", _scan(F.col("text")).alias("r")).select("doc_id", "r.*")


def redacted(text: Column) -> Column:
    """The text without its secrets."""
    return _redact(text)
