"""Secret scans: fixed patterns, and assignment-aware lexing of source and configuration syntax.

The lexer reads ``name = literal`` and ``name: literal`` (bare, quoted, exported, in JSON or YAML, with
string concatenation), keeps the constants it has seen, resolves a name on the right-hand side to its
literal, and scores each literal by the name it ends up under. A literal whose target is sensitive and that
looks random enough is a span of its own kind, beside those of the fixed patterns.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "literal")
# The patterns of the base kinds.
ASSIGN = re.compile(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "key")
#: Names that make a literal sensitive, and the weight of each.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "api_key": 3, "privatekey": 3, "private_key": 3, "access_key": 3, "accesskey": 3, "client_secret": 3, "credential": 2, "credentials": 2, "auth": 2, "bearer": 2, "key": 1, "salt": 1, "signature": 1}
#: A literal is reported at this score: the weight of its name and what its shape adds.
ENOUGH = 4.0
# A name is taken as a whole run and never given back, so that a long word is read once.
ASSIGNMENT = re.compile(r"""(?a)(?<![A-Za-z0-9_.\-])([A-Za-z0-9_.\-]++)["']?[ \t]*+(?::=|=>|=(?!=)|:(?!//))[ \t]*""")
LITERAL = re.compile(r"""(?a)"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([A-Za-z0-9+/_.=\-]+)""")
PLUS = re.compile(r"[ \t]*\+[ \t]*")


class Value:
    """A literal, or what a concatenation adds up to: its spans, and the shape of the whole.

    Parts are shared with the constants they come from and not copied; ``told`` is set once all spans below
    are reported, so that no part is walked twice.
    """

    __slots__ = ("parts", "shares", "length", "space", "classes", "told")

    def __init__(self):
        self.parts: list = []
        self.shares: dict[str, float] = {}
        self.length, self.space, self.classes, self.told = 0.0, False, 0, False

    def _add(self, shares: dict[str, float], length: float, space: bool, classes: int) -> None:
        whole = self.length + length
        if length and self.length:
            mine = {c: v * self.length / whole for c, v in self.shares.items()}
            for c, v in shares.items():
                mine[c] = mine.get(c, 0.0) + v * length / whole
            self.shares = mine
        elif length:
            self.shares = dict(shares)
        self.length, self.space, self.classes = min(whole, 1e9), self.space or space, self.classes | classes

    def add_text(self, start: int, end: int, text: str) -> None:
        self.parts.append((start, end))
        n = len(text)
        classes = sum(1 << i for i, f in enumerate((str.islower, str.isupper, str.isdigit)) if any(map(f, text)))
        self._add({c: k / n for c, k in Counter(text).items()} if n else {}, n, " " in text, classes)

    def add_value(self, other: Value) -> None:
        self.parts.append(other)
        self._add(other.shares, other.length, other.space, other.classes)

    def spans(self) -> set[tuple[int, int]]:
        """Spans of all parts that no call has given before."""
        found, open_ = set(), [self]
        while open_:
            now = open_.pop()
            if now.told:
                continue
            now.told = True
            for part in now.parts:
                if isinstance(part, Value):
                    open_.append(part)
                elif part[0] < part[1]:
                    found.add(part)
        return found


def shape_score(value: Value) -> int:
    """What the shape of a literal adds: length, mixed classes and entropy, 0 to 3; 0 for ordinary words."""
    if value.length < 8 or value.space:
        return 0
    entropy = -sum(v * math.log2(v) for v in value.shares.values() if v > 0)
    return (entropy >= 3.0 - 1e-9) + (value.classes.bit_count() >= 2) + (value.length >= 16)


def name_weight(name: str) -> int:
    low = name.lower().replace("-", "_")
    last = re.split(r"[.]", low)[-1]
    return max((w for k, w in SENSITIVE.items() if last == k or last.endswith("_" + k) or (w >= 3 and k in last)), default=0)


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals under sensitive names, constants propagated; in order, without repeats.

    A bare literal is read once: an assignment inside it is part of it. The work grows with the text's
    length, whatever it holds.
    """
    constants: dict[str, Value] = {}
    found: set[tuple[int, int]] = set()
    past = 0
    for m in ASSIGNMENT.finditer(text):
        name = m.group(1).lstrip("0123456789.-")
        if not name or m.start() < past:
            continue
        value, at = Value(), m.end()
        while x := LITERAL.match(text, at):
            group = x.lastindex
            literal = x.group(group)
            if group == 3:
                past = x.end()
            if group == 3 and literal in constants:
                value.add_value(constants[literal])
            else:
                value.add_text(x.start(group), x.end(group), literal)
            plus = PLUS.match(text, x.end())
            if not plus:
                break
            at = plus.end()
        if not value.parts:
            continue
        constants[name] = value
        weight = name_weight(name)
        if weight and weight + shape_score(value) >= ENOUGH:
            found |= value.spans()
    return sorted(found)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start, then kind as listed."""
    low = text.lower()
    found = []
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def all_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans and the lexer's, which has nothing to read in a text without ``=`` or ``:``."""
    more = [("literal", s, e) for s, e in lexed(text)] if "=" in text or ":" in text else []
    return sorted([*base_spans(text), *more], key=lambda s: (s[1], KINDS.index(s[0])))


def _render(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            spans = all_spans(text or "")
            base = [s for s in spans if s[0] != "literal"]
            n = Counter(k for k, _, _ in spans)
            rows.append((*(n[k] for k in KINDS), hashlib.sha256(_render(base).encode()).hexdigest(), _render(spans)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        columns = [batch.column("doc_id").cast(pa.int64()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """Secrets in each of ``docs(doc_id, text)``: counts by kind, digest of the base spans, all spans.

    A span is ``kind:start:end`` in code points, end exclusive. A null text counts as empty and has no
    spans; a null doc_id stays null. Every row is scanned by itself, so repeated rows come back repeated
    and an empty table stays empty; other columns are ignored. No shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)
