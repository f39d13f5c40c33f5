"""Secret scan: assignment-aware lexing of source and configuration text, beside base patterns.

The lexer reads `name = literal`, `name: literal`, `"name": "literal"`, `export NAME=literal`,
`name => literal`, `name: type = literal`, `name = other = literal` and the like into pairs of a (dotted, quoted or plain) name and a value. A value is
a string literal, a joined run of literals and known names (`"ab" + tail`), an unquoted word, or
another name. Constants are propagated: a name that stands as a value carries the literals it was
given before, so `x = "..."` followed by `client.secret = x` marks the literal in the first line. Each
literal is scored by how sensitive the names are that it reaches, and by its own shape (length, mix
of character classes, entropy, placeholders); those at or above the threshold become spans of kind
`lexed`.

Names may be subscripts (`cfg["name"] = literal`, `x = cfg["name"]`), literals may stand between three quotes.
Looser places give pairs as well, whose literal must then mix letters and digits: a call's argument
(`name = f("literal")`, `set_name("literal")`, `put("name", "literal")`), a command's option
(`--name literal`), an attribute or element (`key="name" value="literal"`, `<name>literal</name>`).

A name shares the values of the names it was joined from and copies no literals, and scores go back over these
shares once at the end, so a text takes time in proportion to its length.

Base spans are kept whatever the lexer says. Spans are in code points, end exclusive.

Defined results: null and empty texts have no spans; repeated rows are scanned each; whole texts are
scanned, however long; additional columns are kept by `redact` and ignored by `scan`.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridledger.llm.common import map_arrow, strings

KINDS = ("assign", "access", "hex", "lexed")

# The base patterns. ASCII letters only, in either case where so marked.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# An assign match needs one of these in the lower-cased text.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20

# Weight of words in a target name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0,
    "token": 1.0, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7,
    "authorization": 0.8, "bearer": 0.9, "private": 0.6, "access": 0.5, "signing": 0.6,
    "encryption": 0.6, "api": 0.4, "key": 0.4, "client": 0.2, "session": 0.4, "salt": 0.5,
}
PLACEHOLDERS = re.compile(
    r"^(?:x+|\*+|\.+|<.*>|\$\{?.*|%.*%|\{\{.*\}\}|changeme|change_me|example|none|null|true|false|"
    r"todo|your[_-].*|test|dummy|password|secret|token)$",
    re.IGNORECASE,
)
THRESHOLD = 0.6

NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
WHOLE_NAME = NAME + "+"
QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
# Literals with blanks inside are no secrets, so three quotes are read around one word only.
LITERAL = rf"\"\"\"\s*+[^\s\"\\]++\s*+\"\"\"|'''\s*+[^\s'\\]++\s*+'''|{QUOTED}"
SUBSCRIPT = rf"{WHOLE_NAME}\[[\"']{WHOLE_NAME}[\"']\]"
ATOM = rf"(?:{LITERAL}|{SUBSCRIPT}|[A-Za-z0-9+/_=.\-]+)"
# What may stand between the first name and the value: a further name, or a type (`&'a str`, `a::B<C>[]?`, `X | None`).
SIMPLE = r"[&*]?(?:'[a-z_]++[ \t]+)?(?:(?:dyn|mut|const)[ \t]+)?[A-Za-z_][A-Za-z0-9_.\-]*+(?:::[A-Za-z_][A-Za-z0-9_]*+)*+(?:[<\[][^=\"\n;(){}]{0,80}[>\]])?(?:\[\])*+[?!]?"
BETWEEN = rf"(?:{SIMPLE}(?:[ \t]*\|[ \t]*{SIMPLE})*+|\"{NAME}\"|'{NAME}')"
GIVES = r"(?:[ \t]+=(?![=>])[ \t]*|=(?=[ \t]*[\"'])[ \t]*)"
# name, operator, types or further names of a chain, then one value or several joined by +, . or blanks between literals
PAIR = re.compile(
    rf"(?<![A-Za-z0-9_.\-])[\"']?({NAME})[\"']?\]?[ \t]*(=>|:=|=(?!=)|:(?!:|//))[ \t]*"
    rf"((?:{BETWEEN}{GIVES})*)({ATOM}(?:[ \t]*\+[ \t]*{ATOM})*)"
)
LINK = re.compile(f"({BETWEEN}){GIVES}")
PART = re.compile(ATOM)
ARGUMENT = re.compile(rf"\([ \t]*({LITERAL})")
# Looser places: each gives a name and a literal (or, in the second call form, a known name).
SETTER = re.compile(rf"(?<![A-Za-z0-9_\-])((?:set|with|use|add)[A-Z_]{WHOLE_NAME[len('[A-Za-z_]'):]})\([ \t]*({LITERAL})[ \t]*\)")
PUT = re.compile(rf"\([ \t]*[\"']({WHOLE_NAME})[\"'][ \t]*,[ \t]*({LITERAL}|{WHOLE_NAME})")
OPTION = re.compile(rf"(?<![\w\-])--?({WHOLE_NAME})(?:=|[ \t]+)({LITERAL}|[^\s\"'<>\-][^\s\"'<>]*)")
ATTRIBUTE = re.compile(rf"\b(?:key|name|id)[ \t]*=[ \t]*[\"']({WHOLE_NAME})[\"'][ \t]+value[ \t]*=[ \t]*({LITERAL})")
ELEMENT = re.compile(rf"<({WHOLE_NAME})>([^<>\s]++)</")
LOOSE = (("(", SETTER), ("(", PUT), ("-", OPTION), ("value", ATTRIBUTE), ("</", ELEMENT))
CAPITALS = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$")  # the name of a variable of the environment
CLASSES = [(1 << i, re.compile(p)) for i, p in enumerate(("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]", r"\s"))]
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, leftmost and not overlapping per kind."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [
            (m.start(), 0, m.end())
            for m in ASSIGN.finditer(text)
            if len(m.group(2)) >= ASSIGN_LENGTH
        ]
    if "AKIA" in text:
        found += [
            (m.start(), 1, m.end())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= ACCESS_LENGTH
        ]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def name_weight(name: str) -> float:
    """Sensitivity of a target name from the words in it (snake, kebab, dotted or camel case)."""
    words = [w.lower() for w in WORDS.findall(name)]
    weight = sum(SENSITIVE.get(w, 0.0) for w in words)
    for pair in zip(words, words[1:]):
        weight += SENSITIVE.get("".join(pair), 0.0)
    return min(1.0, weight)


def shape(value: str) -> tuple[np.ndarray, int]:
    """How often each code point (modulo 256) stands in a value, and its classes as bits (16: blank)."""
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32) & 255
    classes = sum(bit for bit, pattern in CLASSES if pattern.search(value))
    return np.bincount(codes, minlength=256).astype(np.float32), classes


def shortened(value: str) -> str:
    """Both ends of a long value, which is all that tells placeholders."""
    return value if len(value) <= 64 else f"{value[:32]}\0{value[-32:]}"


def weigh(counts: np.ndarray, classes: int, ends: str) -> float:
    """How much a value looks like a secret, from 0 to 1."""
    length = float(counts.sum())
    if length < 6 or classes & 16 or PLACEHOLDERS.match(ends):
        return 0.0
    share = counts[counts > 0] / length
    entropy = -float((share * np.log2(share)).sum())
    return min(1.0, 0.25 * min(length, 20) / 20 + 0.5 * min(entropy, 4.0) / 4 + 0.125 * (classes.bit_count() - 1))


def literal_weight(value: str) -> float:
    return weigh(*shape(value), shortened(value))


class Carried:
    """What a name carries: spans of literals and the values of other names, shared and not copied."""

    __slots__ = ("parts", "weight", "wanted", "score", "counts", "classes", "ends")

    def __init__(self, parts: list):
        self.parts, self.weight, self.wanted, self.score = parts, 0.0, False, 0.0

    def measure(self, text: str) -> None:
        """Shape and score of the whole value, from those of its parts."""
        self.counts, self.classes, self.ends = np.zeros(256, np.float32), 0, ""
        for part in self.parts:
            if isinstance(part, Carried):
                counts, classes, ends = part.counts, part.classes, part.ends
            else:
                value = text[part[0] : part[1]]
                (counts, classes), ends = shape(value), shortened(value)
            self.counts += counts
            self.classes |= classes
            self.ends = shortened(self.ends + ends)
        if self.counts.sum() > 1e12:  # names joined with themselves: from here on only shares matter
            self.counts /= 2**20
        if self.weight and self.parts:
            self.score = self.weight * weigh(self.counts, self.classes, self.ends)


def inside(text: str, start: int, end: int) -> tuple[int, int]:
    """Span of a literal without its quotes and the blanks within three of them."""
    if text[start] not in "\"'":
        return start, end
    if end - start > 6 and text[start] * 3 == text[start : start + 3]:
        value = text[start + 3 : end - 3]
        return start + 3 + len(value) - len(value.lstrip()), end - 3 - len(value) + len(value.rstrip())
    return start + 1, end - 1


def mixed(value: str) -> bool:
    """Letters and digits: what a literal in a looser place must have."""
    return bool(re.search("[0-9]", value) and re.search("[A-Za-z]", value))


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of literals that reach a sensitive name."""
    places = [(m.start(), 0, m) for m in PAIR.finditer(text)] if "=" in text or ":" in text else []
    for hint, pattern in LOOSE:
        if hint in text:
            places += [(m.start(), 1, m) for m in pattern.finditer(text) if name_weight(m.group(1))]
    held: dict[str, Carried] = {}
    values: list[Carried] = []  # a value comes after those it shares
    scores: dict[tuple[int, int], float] = {}

    def known(word: str) -> Carried | None:
        return held.get(word) or held.get(word[:-2].rpartition("[")[2][1:] if word.endswith("]") else "")

    def carried(parts: list) -> Carried:
        if len(parts) == 1 and isinstance(parts[0], Carried):
            return parts[0]
        values.append(Carried(parts))
        return values[-1]

    for _, loose, found in sorted(places, key=lambda p: p[:2]):
        if loose:
            start, end = inside(text, *found.span(2))
            value = known(found.group(2))
            if value is None and end > start and mixed(text[start:end]):
                value = carried([(start, end)])
            if value is not None:
                value.weight = max(value.weight, name_weight(found.group(1)))
            continue
        names = [found.group(1)]
        at = found.start(3)
        while at < found.end(3) and (link := LINK.match(text, at)):
            between = link.group(1)
            if at > found.start(3) or found.group(2) != ":":
                names.append(between)
            if re.search("[0-9]", between):  # may be a value itself
                weight = name_weight(names[0]) * literal_weight(between)
                scores[link.span(1)] = max(scores.get(link.span(1), 0.0), weight)
            at = link.end()
        parts: list = []
        atoms = list(PART.finditer(text, found.start(4), found.end(4)))
        call = ARGUMENT.match(text, found.end(4)) if len(atoms) == 1 else None
        if call:
            span = inside(text, *call.span(1))
            parts += [span] if mixed(text[slice(*span)]) and not CAPITALS.match(text[slice(*span)]) else []
        for atom in () if call else atoms:
            word = atom.group()
            if word[0] in "\"'":
                parts.append(inside(text, *atom.span()))
            elif (value := known(word)) is not None:
                parts.append(value)
            elif len(atoms) == 1 and not word.endswith((".", "]")):
                parts.append(atom.span())
        value = carried([p for p in dict.fromkeys(parts) if isinstance(p, Carried) or p[1] > p[0]])
        for name in names:
            held[name] = value
        value.weight = max(value.weight, *map(name_weight, names))
    # Only values that reach a sensitive name are measured, those they share before them.
    for value in reversed(values):
        value.wanted |= value.weight > 0
        for part in value.parts if value.wanted else ():
            if isinstance(part, Carried):
                part.wanted = True
    for value in values:
        if value.wanted:
            value.measure(text)
    for value in reversed(values):
        for part in value.parts if value.score else ():
            if isinstance(part, Carried):
                part.score = max(part.score, value.score)
            else:
                scores[part] = max(scores.get(part, 0.0), value.score)
    return [(a, 3, b) for (a, b), score in scores.items() if score >= THRESHOLD]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: counts of the base kinds, hash of the base spans, all spans."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in strings(batch.column(1)):
            base = base_spans(text)
            n = Counter(k for _, k, _ in base)
            lexed = lexed_spans(text)
            rows.append(
                (
                    n[0], n[1], n[2],
                    hashlib.sha256(joined(base).encode()).hexdigest(),
                    joined(base + lexed),
                    len(lexed),
                )
            )
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *(pa.array(columns[i], pa.int64()) for i in range(3)),
                *(pa.array(columns[i], pa.string()) for i in (3, 4)),
                pa.array(columns[5], pa.int64()),
            ],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", "text"),
        work,
        f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, "
        "base_sha256 string, spans string, n_lexed bigint",
    )


def redacted(text: str, mark: str) -> str:
    """The text with every found span (assign: only its value) replaced by `mark`."""
    cuts = []
    for start, kind, end in base_spans(text) + lexed_spans(text):
        if kind == 0:
            start = ASSIGN.match(text, start).start(2)
        cuts.append((start, end))
    out, at = [], 0
    for start, end in sorted(cuts):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """Documents with their secrets replaced; all rows and columns stay, null texts stay null."""
    hidden = [f.name for f in docs.schema if f.name != "text"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        texts = [None if t is None else redacted(t, mark) for t in batch.column(at).to_pylist()]
        arrays = [
            pa.array(texts, pa.string()) if i == at else batch.column(i)
            for i in range(batch.num_columns)
        ]
        return pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    schema = T.StructType(
        [f if f.name in hidden else T.StructField("text", T.StringType()) for f in docs.schema]
    )
    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in docs.columns]), work, schema)
