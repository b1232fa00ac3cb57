"""Secret scans: three base patterns, and literals that source or configuration syntax binds to sensitive names.

The method lexes a text into strings, names, references and operators and reads bindings of a name to a literal from
them: assignments and keyword arguments, mappings and headers, ``define(name, literal)`` and setters, command-line
options, XML elements, records of a name and a value beside it, and the user part of a URL. Literals carry over:
a constant that is bound earlier in the text stands for its parts wherever it is referred to, in concatenations and
inside strings, however long the chain. A literal is reported if the sensitivity of the name it ends up in times its own
strength (entropy, kinds of characters, no placeholder) reaches ``THRESHOLD`` and no base span holds it already.

Texts without any part of a sensitive name, which cannot score, are passed over by searching their bytes; whole texts are
read, in one pass without a shuffle, and every document is on its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import text_of
from txnlens.llm.textual import encoded, parts

KINDS = ("assign", "access", "hex", "lexed")  # fixed order of kinds among spans of equal start
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])
FOUND = "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint,name:string,score:double>>"
THRESHOLD = 0.5

# The base patterns and how long what they find must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

# How sensitive the parts of a name are, what takes that back, and what stands for no secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "pwd": 1.0, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.8, "credentials": 0.8, "authorization": 0.9, "auth": 0.7, "bearer": 0.8, "privatekey": 1.0, "secretkey": 1.0, "accesskey": 1.0,
}
KEY_OWNERS = {"api", "access", "private", "secret", "signing", "encryption", "master", "session", "account", "storage", "shared", "service", "license"}
HARMLESS = {
    "name", "id", "type", "url", "uri", "path", "file", "field", "length", "len", "size", "min", "max", "policy", "hint", "label", "prompt", "count",
    "expiry", "expires", "ttl", "header", "prefix", "regex", "pattern", "placeholder", "enabled", "required", "endpoint", "public",
}
PLACEHOLDER = re.compile(
    r"change.?me|example|placeholder|redacted|dummy|sample|your[-_ ]|insert[-_ ]|todo|x{4,}|\*{3,}|\.{3,}|^<.*>$|^(null|none|nil|true|false|undefined)$", re.I)
RECORD_NAMES, RECORD_VALUES = {"name", "key", "property"}, {"value", "val", "default", "content"}
LOOKUPS = {"getenv", "get", "env", "fetch", "getproperty", "getorelse", "lookup"}  # their first argument is a name
SCHEMES = {"bearer", "basic", "token"}  # words before the literal of a header

FRAGMENTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"bearer", b"://")
_LEX = re.compile(r'''
    (?P<string>(?<![A-Za-z0-9_])[bBrRfFuU]{0,2}(?:"""(?:[^\\"]|\\.|"(?!""))*"""|\'\'\'(?:[^\\']|\\.|'(?!''))*\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|`[^`\n]*`)
  | (?P<url>[A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>`]+)
  | (?P<ref>\$\{[A-Za-z_]\w*\}|\$[A-Za-z_]\w*)
  | (?P<option>(?<![\w-])--[A-Za-z][\w-]*)
  | (?P<name>[A-Za-z_]\w*(?:(?:\.|->|::|-)[A-Za-z_]\w*)*)
  | (?P<op>:=|=>|==|!=|<=|>=|\?\?|\|\||&&|[=:+.,&()\[\]{}<>;\n])
  | (?P<other>[^\s"'`]+?(?=[\s"'`=:+.,&()\[\]{}<>;]|$)|\S)''', re.X | re.A)
_WORD = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\s]+)</\1>")
_LOGIN = re.compile(r"://[^\s/:@\"'<>`]*:([^\s/@\"'<>`]+)@")
_INSIDE = re.compile(r"\$\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)|\{([A-Za-z_]\w*)\}")
_JOINS = {"+", ".", "&", "||", "??", "or"}
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[48:58] = _HEX_BYTE[97:103] = True


@lru_cache(maxsize=4096)
def name_weight(name: str) -> float:
    """How sensitive a target name is, from 0 to 1."""
    split = re.sub(r"([a-z0-9])([A-Z])|([A-Z])([A-Z][a-z])", r"\1\3_\2\4", name).lower()
    words = [w for w in re.split(r"[^a-z0-9]+", split) if w]
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    if any(b == "key" and a in KEY_OWNERS for a, b in zip(words, words[1:])):
        best = 1.0
    return best * (0.3 if words and (words[-1] in HARMLESS or "public" in words) else 1.0)


def literal_strength(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret, from 0 to 1."""
    if len(value) < 6 or re.search(r"\s", value) or PLACEHOLDER.search(value):
        return 0.0
    bits = -sum(n * math.log2(n / len(value)) for n in Counter(value).values())
    strength = min(1.0, bits / 24)
    if re.fullmatch(r"[^\W\d]+([.-][^\W\d]+)*", value):  # words only
        strength *= 0.6 if quoted else 0.3
    return strength * (0.2 if re.match(r"[a-z+]+://|\.{0,2}/|[A-Za-z]:\\", value) and "@" not in value else 1.0)


class _Bindings:
    """Bindings of names to literals, in the order of the text; ``found`` has those of sensitive names.

    A value is a list of parts ``(start, end, quoted)``, each a stretch of the text. ``known`` has what each name was
    last bound to.
    """

    def __init__(self, text: str):
        self.text, self.known = text, {}
        self.tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _LEX.finditer(text)]
        self.found: list[tuple[str, list[tuple[int, int, bool]]]] = []
        self.close: dict[int, int] = {}  # the closing bracket of each opening one
        opened: list[int] = []
        for i, (_, token, *_) in enumerate(self.tokens):
            if token in ("(", "["):
                opened.append(i)
            elif token in (")", "]") and opened:
                self.close[opened.pop()] = i

    def _at(self, i: int) -> tuple[str, str, int, int]:
        return self.tokens[i] if 0 <= i < len(self.tokens) else ("end", "", len(self.text), len(self.text))

    def _body(self, token) -> tuple[int, int]:
        """Where a string's content lies."""
        _, text, start, end = token
        prefix = len(text) - len(text.lstrip("bBrRfFuU"))
        mark = 3 if text[prefix:prefix + 3] in ('"""', "'''") and len(text) >= prefix + 6 else 1
        return start + prefix + mark, end - mark

    def _string(self, token) -> list[tuple[int, int, bool]]:
        """The parts of a string, with known names that it refers to in their place."""
        at, end = self._body(token)
        out = []
        for m in _INSIDE.finditer(self.text, at, end):
            inner = self.known.get(next(g for g in m.groups() if g))
            if inner is not None:
                out += [(at, m.start(), True), *inner]
                at = m.end()
        return [p for p in [*out, (at, end, True)] if p[1] > p[0]]

    def _call(self, i: int, name: str) -> tuple[list[tuple[int, int, bool]], int]:
        """The string arguments of a call whose bracket is token ``i``, and the token after it.

        Arguments of calls inside count, what those nest in turn does not: a text of brackets is read once or twice.
        """
        end = self.close.get(i)
        if end is None:
            return [], i + 1
        out, args, inner, at = [], 0, 0, i + 1
        lookup = re.split(r"\W", name)[-1].lower() in LOOKUPS
        while at < end:
            kind, text, *_ = token = self._at(at)
            if text in ("(", "["):
                if inner and at in self.close:
                    at = self.close[at]
                elif at in self.close:
                    inner = self.close[at]
            elif at == inner:
                inner = 0
            args += not inner and text == ","
            if kind == "string" and (args or not lookup):
                out += self._string(token)
            at += 1
        return out, end + 1

    def _value(self, i: int) -> list[tuple[int, int, bool]]:
        """The parts of the expression that begins with token ``i``."""
        out: list[tuple[int, int, bool]] = []
        while True:
            kind, text, start, _ = token = self._at(i)
            if kind == "string":
                out += self._string(token)
                i += 1
            elif kind in ("name", "ref") and (text.strip("${}") in self.known or self._at(i + 1)[1] in ("(", "[")):
                plain = text.strip("${}")
                if plain in self.known:
                    out += self.known[plain]
                    i += 1
                else:
                    more, i = self._call(i + 1, text)
                    out += more
            elif kind in ("name", "other", "url", "option") and not out:
                word = _WORD.match(self.text, start)
                if word is None or text.lower() in SCHEMES and word.group().lower() in SCHEMES:
                    i += 1
                    if word is None or self._at(i)[0] == "end":
                        return out
                    continue
                return [(word.start(), word.end(), False)]
            else:
                return out
            if self._at(i)[1] not in _JOINS:
                return out
            i += 1
            if self._at(i)[1] == "\n":  # an expression that goes on in the next line
                i += 1

    def _target(self, i: int) -> str | None:
        """The name that the operator at token ``i`` binds."""
        j = i - 1
        if self._at(j)[1] in ("]", ")"):
            j -= 1
        kind, text, start, end = token = self._at(j)
        if kind == "string":
            return self.text[slice(*self._body(token))]
        if kind == "name" and self._at(j - 1)[1] == ":" and self._at(i)[1] == "=" and self._at(j - 2)[0] == "name":
            return self._at(j - 2)[1]  # name: type = value
        if kind == "option":
            return text[2:]
        return text if kind in ("name", "ref") else None

    def _bind(self, name: str, value: list[tuple[int, int, bool]]) -> None:
        if value:
            value = list(dict.fromkeys(value))  # a constant that a value holds twice counts once
            self._report(name, value)
            self.known[name.strip("${}")] = value

    def _report(self, name: str, value: list[tuple[int, int, bool]]) -> None:
        if name_weight(name) >= THRESHOLD:
            self.found.append((name, value))

    def read(self) -> list[tuple[str, list[tuple[int, int, bool]]]]:
        record = None  # the literal of the last "name": a following "value" belongs to it
        for i, (kind, text, start, end) in enumerate(self.tokens):
            after = self._at(i + 1)
            if text in ("=", ":", ":=", "=>") and kind == "op":
                name = self._target(i)
                if name is None or after[1] == "\n":
                    continue
                value = self._value(i + 1)
                base = re.split(r"\W", name)[-1].lower()
                if base in RECORD_VALUES and record:
                    self._bind(record, value)
                    record = None
                else:
                    self._bind(name, value)
                    if base in RECORD_NAMES and len(value) == 1:
                        record = self.text[value[0][0]:value[0][1]]
            elif kind == "option" and after[1] != "=" and after[0] in ("string", "name", "other", "ref"):
                self._bind(text[2:], self._value(i + 1))
            elif kind == "string" and after[1] == "," and self._at(i - 1)[1] == "(":
                if self._at(i + 2)[0] in ("string", "name"):
                    self._bind(self.text[slice(*self._body((kind, text, start, end)))], self._value(i + 2))
            elif kind == "name" and after[1] == "(" and self._at(i + 2)[0] in ("string", "name") and self._at(i + 3)[1] == ")":
                value = self._value(i + 2)
                if value:
                    self._report(text, value)
        for m in _ELEMENT.finditer(self.text):
            self._report(m.group(1), [(*m.span(2), False)])
        self.found += [("password", [(*m.span(1), True)]) for m in _LOGIN.finditer(self.text)]
        return self.found


def lexed_spans(text: str) -> dict[tuple[int, int], tuple[str, float]]:
    """The literals bound to sensitive names: for each stretch of the text the name and the greatest score."""
    best: dict[tuple[int, int], tuple[str, float]] = {}
    for name, value in _Bindings(text).read():
        whole = "".join(text[a:b] for a, b, _ in value)
        score = name_weight(name) * literal_strength(whole, all(q for *_, q in value))
        if score >= THRESHOLD:
            for a, b, _ in value:
                if score > best.get((a, b), ("", 0.0))[1]:
                    best[a, b] = (name, score)
    return best


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base patterns, each kind leftmost and without overlap; too short ones are dropped."""
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LENGTH]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m.group()) >= ACCESS_LENGTH]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text) if len(m.group()) >= HEX_LENGTH]


def spans_of(text: str) -> list[tuple[str, int, int, str | None, float | None]]:
    """All spans of a text by start and kind: kind, start, end in characters, and name and score of lexed ones."""
    base = base_spans(text)
    out = [(kind, a, b, None, None) for a, b, kind in base]
    for (a, b), (name, score) in lexed_spans(text).items():
        if not any(x <= a and b <= y for x, y, _ in base):
            out.append(("lexed", a, b, name, score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _suspects(texts: list[bytes]) -> np.ndarray:
    """Which texts may hold a span: those with part of a sensitive name, ``AKIA`` or a long run of hex digits."""
    out = np.zeros(len(texts), bool)
    for lo, hi in parts(texts):
        data = b" ".join(texts[lo:hi]) + b" "
        edge = np.flatnonzero(np.diff(_HEX_BYTE[np.frombuffer(data, np.uint8)], prepend=False))
        long_runs = edge[::2][np.diff(edge)[::2] >= HEX_LENGTH]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
        out[lo + np.searchsorted(begins, long_runs, side="right") - 1] = True
        small = data.lower()
        if b"AKIA" in data or any(f in small for f in FRAGMENTS):
            for i in range(lo, hi):
                low = texts[i].lower()
                out[i] |= b"AKIA" in texts[i] or any(f in low for f in FRAGMENTS)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ("kind", "start", "end", "name", "score")
    for batch in batches:
        texts = encoded(batch.column("text").to_pylist())
        found: list[list[dict]] = [[] for _ in texts]
        for i in np.flatnonzero(_suspects(texts)):
            found[i] = [dict(zip(keys, s, strict=True)) for s in spans_of(texts[i].decode("utf-8", "surrogatepass"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(SPAN))], ["doc_id", "found"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, found`` for each row of ``docs``: the spans of its text with kind, place, name and score.

    A null text is empty and has no spans; a null id stays; rows that repeat each give a row, an empty table gives none.
    Offsets are in code points, the end excluded. Other columns are ignored.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(_scan, FOUND)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def secret_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of each row: counts and a hash of the base spans, and all spans."""
    found = F.col("found")
    counts = [F.size(_of_kind(found, kind)).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    base = F.filter(found, lambda s: s["kind"] != "lexed")
    return scan_secrets(docs).select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(found).alias("spans"))
