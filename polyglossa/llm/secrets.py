"""Secret scans by assignment-aware lexing.

Three base patterns are matched over the whole text. Beside them a small lexer reads source and configuration syntax into
(name, literal) pairs: `name = "literal"`, `name: literal`, `"name": "literal"`, `export NAME=literal`, `name := literal`,
`name["key"] = "literal"`, `name: type = "literal"`, and sums of literals and of names, whose constants it propagates (a text is one
scope; the latest assignment before the use counts). Literals without quotes are values only if they are no code: no call, index or
plain identifier. A pair is reported as `literal` spans when the name is sensitive and the value is no placeholder; the spans are those of its
literals where they are written. A sum holds its terms by reference and of its value only what the score asks for, so constants that are
added to themselves again and again cost no more than their lines. Every pattern starts at most once in a word and does not go back: time grows with the
text and, for sums, with the number of different characters.

Null text counts as empty. Rows are scanned one by one, repeated rows alike; a null doc_id stays null. Spans are in code points,
end exclusive, over texts of any length. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A run that is long enough is found whole, as a run starts at its first letter.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A type between `:` and `=`: a name with brackets and marks, or several joined by bars.
_ATOM = r"""(?:&(?:'\w+[\x20\t]+)?(?:mut[\x20\t]+)?|\[\]|\*)*[A-Za-z_][\w.$]{0,80}(?:\[[^\]="'\n]{0,80}\]+|<[^>="'\n]{0,80}>+)*[?!*&]*"""
_TYPE = rf"{_ATOM}(?:[\x20\t]*\|[\x20\t]*{_ATOM})*"
#: Groups: name, type, quote, literal in quotes, literal without.
PAIR = re.compile(
    r"""(?<![\w$.-])[.-]{0,8}+([\w$][\w$.-]*+)(?:["']\]|["'\]])?[\x20\t]*(?::=|=>|:[\x20\t]*(""" + _TYPE + r""")(?:[\x20\t]+=(?![=>~])|=(?=[\x20\t]*["']))|[:=])"""
    r"""[\x20\t]*(?:(["'])((?:(?!\3)[^\\\n]|\\.)*)\3|([^\s"',;(){}\[\]]+))""", re.ASCII
)
PLAIN = re.compile(r"""[^\s"',;(){}\[\]]+""", re.ASCII)
#: A further term of a sum: groups quote, literal, name.
TERM = re.compile(r"""[\x20\t]*\+[\x20\t]*(?:(["'])((?:[^"'\\\n]++|(?!\1)["']|\\.)*+)\1|([A-Za-z_$][\w$.]*+)(?![\x20\t]*[(\[]))""", re.ASCII)
NAME = re.compile(r"[A-Za-z_$][\w$.]*", re.ASCII)
IDENTIFIER = re.compile(r"[A-Za-z_$]+(?:\.[A-Za-z_$]+)*", re.ASCII)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Parts of sensitive names with their weights, and words of placeholders.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "bearer": 2, "auth": 2, "private": 1, "access": 1, "api": 1, "signing": 1, "encryption": 1, "key": 2, "pass": 2}
PLACEHOLDER = re.compile("example|changeme|placeholder|your|dummy|sample|redacted", re.IGNORECASE)
STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")


def name_score(name: str) -> int:
    return sum(SENSITIVE.get(p.lower(), 0) for p in set(PARTS.findall(name.rsplit(".", 1)[-1])))


class Value:
    """What the score needs of a string, in a form that adds up: counts of characters, both ends, whether a placeholder's word is inside.

    Beyond 2**128 characters counts are divided by 2**64, at least 1 staying: shares then hold to one part in 2**64.
    """

    ENDS = len("placeholder") - 1

    def __init__(self, text: str = "") -> None:
        self.counts, self.n, self.scale = Counter(text), len(text), 0
        self.head, self.tail, self.worded = text[: self.ENDS], text[-self.ENDS :], bool(PLACEHOLDER.search(text))

    def copy(self) -> Value:
        out = Value()
        out.counts, out.n, out.scale, out.head, out.tail, out.worded = self.counts.copy(), self.n, self.scale, self.head, self.tail, self.worded
        return out

    def _down(self, scale: int) -> None:
        """Divide by 2**64 for each step up to `scale`."""
        if scale > self.scale:
            self.counts = Counter({c: max(1, k >> 64 * (scale - self.scale)) for c, k in self.counts.items()})
            self.n, self.scale = self.counts.total(), scale

    def add(self, other: Value) -> None:
        """Put other behind."""
        if not other.counts:
            return
        if other.scale != self.scale:
            self._down(other.scale)
            if other.scale < self.scale:
                other = other.copy()
                other._down(self.scale)
        self.worded = self.worded or other.worded or bool(PLACEHOLDER.search(self.tail + other.head))
        self.head = self.head if len(self.head) == self.ENDS else (self.head + other.head)[: self.ENDS]
        self.tail = other.tail if len(other.tail) == self.ENDS else (self.tail + other.tail)[-self.ENDS :]
        for c, k in other.counts.items():
            self.counts[c] += k
        self.n += other.n
        if self.n >> 128:
            self._down(self.scale + 1)

    def entropy(self) -> float:
        return -sum(k / self.n * math.log2(k / self.n) for k in self.counts.values())

    def placeholder(self) -> bool:
        """A word of placeholders inside, all x or stars, <...>, or a variable."""
        one = {c.lower() for c in self.counts}
        return self.worded or one in ({"x"}, {"*"}) or self.head[:1] == "<" and self.tail[-1:] == ">" or self.head[:1] == "$"


def secret_literal(value: Value, score: int) -> bool:
    """Whether a literal that a name of this score holds looks like a secret; surer names need less of it."""
    long = value.n if not value.scale else 1 << 64
    if long < 8 or " " in value.counts or value.placeholder():
        return False
    classes = sum(any(f(c) for c in value.counts) for f in (str.islower, str.isupper, str.isdigit)) + (not all(c.isalnum() for c in value.counts))
    if score < 2 or classes < 2:
        return False
    return score >= 3 and value.entropy() >= 2.5 or long >= 16 and value.entropy() >= 3.2


class Terms:
    """Where a value is written: spans of literals, and the terms of constants it was made from."""

    def __init__(self, *parts: tuple[int, int] | Terms) -> None:
        self.parts, self.told = list(parts), False


def pairs(text: str) -> list[tuple[str, Value, Terms]]:
    """(name, value, terms), with constants propagated; a name's latest value counts."""
    known: dict[str, tuple[Value, Terms]] = {}
    out: list[tuple[str, Value, Terms]] = []
    for m in PAIR.finditer(text):
        names, to = [m[1]], m.end()
        value, terms = None, None
        if m[3]:
            value, terms = Value(m[4]), Terms(m.span(4))
        elif NAME.fullmatch(m[5]) and m[5] in known:
            value, terms = known[m[5]]
        elif text[to : to + 1] in ("(", "[") or IDENTIFIER.fullmatch(m[5]):
            known.pop(m[1], None)  # code, whose value is not known
        else:
            value, terms, to = Value(m[5]), Terms(m.span(5)), len(text)
        if value is not None and (t := TERM.match(text, to)):
            value, terms = value.copy(), Terms(terms)
            written: list[str] = []  # not yet added
            while t:
                if t[1]:
                    written.append(t[2])
                    terms.parts.append(t.span(2))
                elif t[3] in known:
                    value.add(Value("".join(written)))
                    written.clear()
                    value.add(known[t[3]][0])
                    terms.parts.append(known[t[3]][1])
                else:
                    value = None
                    break
                t = TERM.match(text, t.end())
            if value is not None:
                value.add(Value("".join(written)))
        if m[2]:
            # `else: password = "literal"` looks alike, and so does a literal without quotes before another `=`
            if name_score(m[2]) >= 2:
                names.append(m[2])
            if (plain := PLAIN.match(text, m.start(2))) and any(c.isdigit() for c in plain[0]):
                out.append((m[1], Value(plain[0]), Terms(plain.span())))
        for n in names:
            if value is not None:
                known[n] = value, terms
                out.append((n, value, terms))
    return out


def literals(text: str) -> set[tuple[int, int]]:
    """Spans of the literals that sensitive names hold; terms told once are not followed again."""
    found: set[tuple[int, int]] = set()
    for name, value, terms in pairs(text):
        if terms.told or (s := name_score(name)) < 2 or not secret_literal(value, s):
            continue
        left = [terms]
        while left:
            now = left.pop()
            if not now.told:
                now.told = True
                for p in now.parts:
                    left.append(p) if isinstance(p, Terms) else found.add(p)
    return {(a, b) for a, b in found if b > a}


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all findings, sorted."""
    found: list[tuple[int, int, int]] = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if ("=" in text or ":" in text) and any(s in lower for s in STEMS):
        found += [(a, 3, b) for a, b in literals(text)]
    return sorted(found)


def scan_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal; with_text adds `masked`, the text with findings blotted out."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for b in batches:
            rows = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal", "masked")}
            for value in b.column(1):
                text = value.as_py() or ""
                found = scan(text)
                named = [f"{KINDS[k]}:{s}:{e}" for s, k, e in found]
                base = ",".join(x for x, f in zip(named, found) if f[1] < 3)
                n = Counter(k for _, k, _ in found)
                rows["n_assign"].append(n[0])
                rows["n_access"].append(n[1])
                rows["n_hex"].append(n[2])
                rows["n_literal"].append(n[3])
                rows["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                rows["spans"].append(",".join(named))
                if with_text:
                    rows["masked"].append(mask(text, found) if found else value.as_py())
            if not with_text:
                del rows["masked"]
            kinds = {"base_sha256": pa.string(), "spans": pa.string(), "masked": pa.string()}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items())], ["doc_id", *rows])

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long" + ", masked string" * with_text)


def mask(text: str, found: list[tuple[int, int, int]]) -> str:
    """Each run of found characters becomes [SECRET]."""
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
