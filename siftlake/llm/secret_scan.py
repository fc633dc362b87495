"""Secret scans (operator 7): assignment-aware lexing.

Three base patterns give the plain spans. The lexer then reads `name = literal`, `name: literal`, `name => literal` and
`{"name": "literal"}` pairs as they stand in source and configuration text, folds string concatenation, follows names to
the literals that they were given (`KEY = "..."` and later `password = KEY`), and scores each literal by how sensitive
its target name is and how random the literal looks. Literals over the threshold add spans of kind `lex`.

Defined cases: a null or empty text has no spans; a row gives one row; nothing depends on other rows, so ties and
repeated rows need no rule. Extra columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = {"assign": 0, "access": 1, "hex": 2, "lex": 3}

#: How sensitive a part of a name is. Fixed values.
NAMES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "accesskey": 1.0, "privatekey": 1.0, "secretkey": 1.0, "signingkey": 0.9,
    "encryptionkey": 0.9, "clientsecret": 1.0, "connectionstring": 0.8, "bearer": 0.8, "auth": 0.6, "authorization": 0.8,
}
#: Literals that stand for a secret without being one. Fixed values.
PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|-+|none|null|true|false|todo|changeme|change_me|your.*|my.*|example.*|placeholder|password|secret|token|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*|env.*|os\.environ.*)$", re.I)

OPERATOR = re.compile(r"=>|:=|[=:]")
NAME_BEFORE = re.compile(r"""(?:(["'])([A-Za-z_][\w.\- ]{0,80})\1|([A-Za-z_$][\w.\-$]{0,80})(?:\[["']([\w.\-]{1,80})["']\])?)[ \t]*$""", re.A)
QUOTED = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`""")
JOIN = re.compile(r"[ \t]*(?:\+|\.|\\\n)?[ \t]*(?=[\"'])")
BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
IDENT = re.compile(r"\$?\{?([A-Za-z_][\w.]{0,80})\}?$", re.A)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def sensitivity(name: str) -> float:
    """The highest weight of one part, or of two neighbouring parts, of a name in snake, kebab, dotted or camel case."""
    parts = [x.lower() for x in PARTS.findall(name)]
    return max((NAMES.get(x, 0.0) for x in [*parts, *map("".join, zip(parts, parts[1:], strict=False))]), default=0.0)


def randomness(literal: str) -> float:
    """0 to 1: Shannon bits of a character against 4 bits, less for short literals and for plain lower-case words."""
    n = len(literal)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, bits / 4) * min(1.0, n / 12) * (0.5 if kinds < 2 else 1.0)


def pairs(text: str) -> list[tuple[str, str, int, int]]:
    """(name, literal, start, end) of every assignment, names followed to the literal that they were last given."""
    out, known = [], {}
    for op in OPERATOR.finditer(text):
        head = text[max(0, op.start() - 90) : op.start()]
        if not (m := NAME_BEFORE.search(head)):
            continue
        name = m[2] or m[4] or m[3]
        at = op.end()
        while at < len(text) and text[at] in " \t":
            at += 1
        if q := QUOTED.match(text, at):
            start, value, end = q.start() + 1, "", q.end()
            while q:  # "a" + "b" is one literal
                value += q[1] or q[2] or q[3] or ""
                end = q.end()
                q = QUOTED.match(text, j.end()) if (j := JOIN.match(text, end)) else None
            end -= 1
        elif b := BARE.match(text, at):
            if op[0] == ":" and text[b.start() : b.start() + 2] == "//":  # a URL's scheme
                continue
            if (i := IDENT.match(b[0])) and i[1] in known:
                value, start, end = known[i[1]]
            else:
                value, start, end = b[0].rstrip("."), b.start(), b.start() + len(b[0].rstrip("."))
        else:
            continue
        if value:
            known[name] = (value, start, end)
            out.append((name, value, start, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [
        *(("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6),
        *(("access", m.start(), m.end()) for m in ACCESS.finditer(text)),
        *(("hex", m.start(), m.end()) for m in HEX.finditer(text)),
    ]


def lexed_spans(text: str, threshold: float) -> list[tuple[str, int, int, float, str]]:
    """(kind, start, end, score, name): scored literals, each place once."""
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for name, value, start, end in pairs(text) if re.search("[=:]", text) else ():
        if len(value) >= 6 and (w := sensitivity(name)) and not PLACEHOLDER.match(value):
            score = w * randomness(value)
            if score >= threshold and score > best.get((start, end), (0.0, ""))[0]:
                best[start, end] = (score, name)
    return [("lex", s, e, score, name) for (s, e), (score, name) in best.items()]


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: its id and `found`, an array of (kind, start, end, score, name) by start, then kind; offsets are code points, end exclusive."""

    def run(x: dict) -> dict:
        found = []
        for text in x["text"]:
            text = text or ""
            spans = [(k, s, e, 1.0, "") for k, s, e in base_spans(text)] + lexed_spans(text, threshold)
            spans.sort(key=lambda v: (v[1], KINDS[v[0]], v[2]))
            found.append([dict(zip(("kind", "start", "end", "score", "name"), v, strict=True)) for v in spans])
        return {"id": x["id"], "found": found}

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return by_batch(rows, f"id {kind}, found array<struct<kind:string,start:long,end:long,score:double,name:string>>", run).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from the spans of `scan`."""
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id_col, count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter("found", lambda s: s["kind"] != "lex")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"), count("lex"),
    )
