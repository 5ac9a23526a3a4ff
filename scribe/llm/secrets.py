"""Secret scans by assignment-aware lexing, beside three base patterns.

Base kinds, leftmost and non-overlapping: assign (a name of five, an operator, a value of 6 or more), access (AKIA keys of
20 or more), hex (24 or more digits). The method lexes source and configuration syntax around each `=`, `:`, `:=` and `=>`
(a type note belongs to its name) into a name and the terms of its right side (quoted literals, bare words, joined by + or
.), keeps what each name was given, follows names that stand for earlier literals, and scores a literal by how sensitive its
target's name is and how much the literal looks like a drawn value. Literals that reach the threshold and lie outside base
spans are added as kind literal.

Lexing goes forward once. A bare word ends at white space, brackets, quotes and separators, at `&name=`, and where a
sensitive name and its operator stand within it; other operators within it belong to it. So no two values share a letter,
and what is known of a value (its letters' counts) is found once and added up where names are joined: all passes are linear.

Defined cases: a null or empty text has no spans; every row gets one result; very long texts are lexed whole; rows repeated
are scanned each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from scribe.llm.common import arrow_map, table

KINDS = ("assign", "access", "hex", "literal")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

#: How sensitive the words of a name are.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.9, "signature": 0.5, "salt": 0.6, "otp": 0.7, "pin": 0.5,
}
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 1.0, ("secret", "key"): 1.0, ("encryption", "key"): 0.9, ("signing", "key"): 0.9, ("account", "key"): 0.9, ("connection", "string"): 0.8}
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|none|null|true|false|undefined|changeme|change_me|example.*|your[_-].*|placeholder|redacted|test|todo|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|os\.environ.*|process\.env.*|getenv.*)$")
THRESHOLD = 0.55

OPERATOR = re.compile(r":=|=>|[=:]")
QUOTED = re.compile(r"""[fFrRbBuU]{0,2}(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)""")
BARE = re.compile(r"""(?=[^\s"'`,;#(){}\[\]<>])[^\s"'`,;#(){}\[\]<>&]*(?:&(?![\w.%\-]*=)[^\s"'`,;#(){}\[\]<>&]*)*""")
OPENS = frozenset("\"'`fFrRbBuU")
GAP = re.compile(r"[ \t]*")
JOIN = re.compile(r"[ \t]*[+.][ \t]*(?=[\"'`A-Za-z_])")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-.")
NAME = re.compile(r"[A-Za-z_$@][\w.\-]*$", re.ASCII)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: Words of type notes, in lower letters; words of other notes are told by their shape.
TYPES = frozenset(
    "str string bytes bytearray byte char wchar_t int integer uint long short float double number bool boolean rune any object unknown auto text"
    " varchar nvarchar nchar void none undefined null int8 int16 int32 int64 uint8 uint16 uint32 uint64 usize isize u8 u16 u32 u64 i8 i16 i32 i64 f32 f64"
    " float32 float64 list dict tuple set map array optional union final literal classvar symbol bigint error cstring slice date datetime".split()
)
DECLARES = frozenset(["var", "let", "const", "val", "final", "static", "readonly", "public", "private", "protected", "export", "declare", "mut", "unsigned", "signed"])
#: A note after a colon and before `=`: `: str =`, `: Optional[str] =`, `: string | undefined =`, `: &'static str =`.
NOTE = re.compile(
    r"""[ \t]*(?:(["'])(?=[^"'\n=]{1,80}\1))?(&(?:'\w+[ \t]+)?(?:mut[ \t]+)?|\*|\[\])?([A-Za-z_]\w*(?:(?:\.|::)\w+)*)"""
    r"""((?:\[[^\n=]{0,60}?\](?!\])|<[^\n=]{0,60}?>(?!>)|[ \t]*\|[ \t]*[\w.]+|[ \t]*[?*&])*)(?(1)\1)[ \t]*(=(?![=>~]))"""
)
#: What stands before `=` in Go and SQL: `name string`, `name []byte`, `name VARCHAR(20)`.
TYPED = re.compile(r"([A-Za-z_$@][\w.]*)[ \t]+(\[\d*\]|\*)*([A-Za-z_][\w.]*)(?:\(\d+\))?$", re.ASCII)
SUBSCRIPTS = re.compile(r"([A-Za-z_$@][\w.]*)[ \t]*((?:\[[ \t]*\w*[ \t]*\][ \t]*)+)$", re.ASCII)
#: Letters before an operator that a name and its notes may take.
NEAR = 200


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    value_start: int
    value_end: int


def base_spans(text: str) -> list[Span]:
    found = []
    low = text.lower()
    if any(n in low for n in ASSIGN_NAMES):
        found += [Span(m.start(), m.end(), "assign", m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [Span(m.start(), m.end(), "access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [Span(m.start(), m.end(), "hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


@lru_cache(4096)
def sensitivity(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    single = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    return max([single, *(SENSITIVE_PAIRS.get(p, 0.0) for p in zip(words, words[1:]))])


class Marks(NamedTuple):
    """What is known of a value's letters."""

    counts: Counter
    placeholder: bool


class Value:
    """What a name stands for: a literal's place, or other values in a row."""

    __slots__ = ("start", "end", "parts", "known")

    def __init__(self, start: int, end: int, parts: tuple[Value, ...] = ()):
        self.start, self.end, self.parts, self.known = start, end, parts, None

    def marks(self, text: str) -> Marks:
        """Found once. Parts are older than what is made of them and have theirs by then."""
        if self.known is None:
            if self.parts:
                own = [p.marks(text) for p in self.parts]
                self.known = Marks(sum((m.counts for m in own), Counter()), all(m.placeholder for m in own))
            else:
                word = text[self.start : self.end]
                self.known = Marks(Counter(word), PLACEHOLDERS.match(word) is not None)
        return self.known


def strength(marks: Marks) -> float:
    """0 to 1: how much a value looks like a drawn one rather than a word, a number or a place holder."""
    size = marks.counts.total()
    if size < LEAST_VALUE or marks.placeholder or len(marks.counts) < 4 or any(c.isspace() for c in marks.counts):
        return 0.0
    bits = -sum(n / size * math.log2(n / size) for n in marks.counts.values())
    classes = sum(any(f(c) for c in marks.counts) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in marks.counts)
    return min(1.0, bits / 4.5 + 0.12 * (classes - 1)) * min(1.0, 0.6 + size / 20)


def is_type(word: str) -> bool:
    """Known words, CamelCase (SecretStr, types.Text) and names in _t."""
    last = re.split(r"\.|::", word)[-1]
    return last.lower() in TYPES or last.endswith("_t") or last[:1].isupper() and not last.isupper() and "_" not in last


def name_before(text: str, at: int) -> tuple[str, int]:
    """The name that ends before an operator, through closing quotes, subscripts and type notes in front of it; its start."""
    start = at
    while start and text[start - 1] in NAME_CHARS:
        start -= 1
    if start < at and (not start or text[start - 1] not in " \t"):  # no type can stand in front
        m = NAME.search(text[start:at])
        return (m.group(), start + m.start()) if m else ("", at)
    low = max(0, at - NEAR)
    low = max(low, text.rfind("\n", low, at) + 1)
    near = text[low:at].rstrip(" \t")
    if near.endswith("]") and (m := SUBSCRIPTS.search(near)):
        inner = m.group(2).strip("[] \t")
        if not inner or inner.isdigit() or sensitivity(m.group(1)) > sensitivity(inner):
            return m.group(1), low + m.start()
    last = max(near.rfind(" "), near.rfind("\t"))  # stands between a name and its type
    head = len(near[: max(0, last)].rstrip(" \t"))
    while last > 0 and head and (near[head - 1].isalnum() or near[head - 1] in "_.$@"):
        head -= 1
    if last > 0 and (m := TYPED.search(near, head)):
        name, shape, word = m.groups()
        declared = re.search(r"\bvar[ \t]+$", near[: m.start()]) is not None
        if name.lower() not in DECLARES and name.lower() not in TYPES and (shape == "[]" or word.lower() in TYPES or declared):
            return name, low + m.start()
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    while end and text[end - 1] in "\"'`]?!":
        end -= 1
    start = end
    while start and text[start - 1] in NAME_CHARS:
        start -= 1
    m = NAME.search(text[start:end])
    return (m.group(), start + m.start()) if m else ("", at)


def note_after(text: str, at: int) -> re.Match | None:
    """The type note that follows a colon at `at`, up to its `=`; None where what follows is a value or another name."""
    m = NOTE.match(text, at)
    return m if m and (m.group(1) or m.group(2) or m.group(4) or is_type(m.group(3))) else None


def pairs(text: str):
    """(name, its sensitivity, terms) of each assignment: terms are [start, end, quoted]. A name and its type note are one target."""
    at = 0
    open_, stop = None, 0  # the last pair while its bare word may still be cut short; where the last bare word met ends
    while m := OPERATOR.search(text, at):
        at = m.end()
        after, before = text[at : at + 1], text[m.start() - 1 : m.start()] if m.start() else ""
        if after == "=" or before in "=!<>:+*/" and before or m.group() == ":" and after in (":", "/"):
            at += after == "="
            continue
        name, first = name_before(text, m.start())
        if not name:
            continue
        weight = sensitivity(name)
        if open_ and m.start() < stop:
            word = open_[2][-1]
            if not weight or first < word[0]:
                continue
            word[1] = first
        if open_:
            yield open_
            open_ = None
        note = note_after(text, at) if m.group() == ":" else None
        if note:
            at = note.end()
            weight = max(weight, sensitivity(note.group(3)))
        terms, pos = [], at
        while True:
            pos = GAP.match(text, pos).end()
            if text[pos : pos + 1] in OPENS and (q := QUOTED.match(text, pos)):
                g = q.lastindex
                terms.append([q.start(g), q.end(g), True])
                pos = at = q.end()
                if not (j := JOIN.match(text, pos)):
                    break
                pos = j.end()
            else:
                if pos >= stop and (w := BARE.match(text, pos)):
                    stop = w.end()
                if pos < stop:
                    terms.append([pos, stop, False])
                break
        if terms and terms[-1][2]:
            yield name, weight, terms
        elif terms:
            open_ = (name, weight, terms)
    if open_:
        yield open_


def literal_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the literals that reach sensitive names, directly or through other names, and look drawn enough."""
    held: dict[str, Value] = {}
    found: dict[int, Value] = {}
    for name, weight, terms in pairs(text):
        values = []
        for start, end, quoted in terms:
            word = "" if quoted else text[start:end].rstrip(".,;")
            if word in held:
                values.append(held[word])  # a constant that stands for its literals
            else:
                values.append(Value(start, end if quoted else start + len(word)))
        own = values[0] if len(values) == 1 else Value(0, 0, tuple(values))
        if len(values) > 1:
            own.marks(text)
        held[name] = own
        if weight and weight * strength(own.marks(text)) >= THRESHOLD:
            todo = [own]
            while todo:
                v = todo.pop()
                if id(v) not in found:
                    found[id(v)] = v
                    todo += v.parts
    return sorted({(v.start, v.end) for v in found.values() if v.start < v.end})


def scan(text: str | None) -> list[Span]:
    """All spans of a text, by start, then kind, then end."""
    if not text:
        return []
    spans = base_spans(text)
    if "=" in text or ":" in text:
        covered = sorted((s.start, s.end) for s in spans)
        starts = [a for a, _ in covered]
        reach = list(accumulate((b for _, b in covered), max))  # how far spans go that start no later
        for a, b in literal_spans(text):
            before = bisect_left(starts, b)
            if not before or reach[before - 1] <= a:
                spans.append(Span(a, b, "literal", a, b))
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def line(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def is_note(text: str, span: Span) -> bool:
    """Whether an assign span's value is the type note of a target."""
    colon = text.rfind(":", span.start, span.value_start)
    note = note_after(text, colon + 1) if colon >= 0 else None
    return note is not None and span.value_start <= note.start(3) < span.value_end <= note.start(5)


def redacted(text: str | None, mark: str = "[REDACTED]") -> str | None:
    """The text with each secret's value replaced by mark; a base span's name and operator stay."""
    spans = sorted((s.value_start, s.value_end) for s in scan(text) if not (s.kind == "assign" and is_note(text, s)))
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id and spans array<struct<kind, start, end>>."""

    def rows(ids: list, texts: list) -> dict:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return {"doc_id": pa.array(ids, pa.int64()), "spans": pa.array([[{"kind": s.kind, "start": s.start, "end": s.end} for s in scan(t)] for t in texts], kind)}

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(own, "doc_id long, spans array<struct<kind:string,start:long,end:long>>", rows, "doc_id", "text")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the value of each secret in the texts; all documents stay."""

    names = docs.columns

    def rows(*cols: list) -> dict:
        out = dict(zip(names, cols))
        old = out["text"]
        out["text"] = [redacted(t) for t in old]
        if "n_chars" in out:
            out["n_chars"] = [n if t is o else len(t) for n, t, o in zip(out["n_chars"], out["text"], old)]
        return {k: pa.array(v, arrow[k]) for k, v in out.items()}

    arrow = {f.name: f.type for f in to_arrow_schema(docs.schema)}
    return arrow_map(docs, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema), rows, *names)
