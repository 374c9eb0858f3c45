"""Secrets in texts: fixed patterns, and credential values that would be hard to guess.

A value in a credential context is cut into the cheapest sequence of words,
dates, repeats, runs, keyboard walks and brute-force spans. The decimal
logarithms of their guesses add up; a value that takes more than STRONG is a
secret even where no fixed pattern knows its form, and an easy one
("password: changeme") is not added. Words are a short list of passwords, then
the whole words of a tokenizer's vocabulary file, which stand by frequency.
Repeats of a unit over SPAN characters are counted as brute force: such a unit
is over STRONG by itself unless it is made of words. After a bare space, where prose goes on
("the token bucket"), only values with a digit are weighed. A value in quotes is
read to its closing quote on the line. Links, paths, calls, dotted names of
letters and references to variables are no values.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.tokens import default_vocabulary

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The runs of 32 and more are the matches of [0-9a-f]+ that are long enough.
HEX = re.compile(r"[0-9a-f]{32,}")
#: A credential's name, longest first; within a word it begins at a capital after a small letter.
NAME = (
    r"""(?:(?i:api|access|private|secret|auth|ssh|encryption|signing)[ _-]?(?i:key)|(?i:pass(?:word|wd|phrase|code|wort)|pwd|secret|token|credentials?|pass|bearer|authorization|auth"""
    r"""|kennwort|zugangscode|geheimnis|contraseña|contrasena|clave|mot[ _-]de[ _-]passe|mdp|jeton))"""
)
CONTEXT = re.compile(rf"""(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])){NAME}""", re.A)
#: What may stand between a name and its value, and the value. A name right after a name is read as its own context.
#: A name may go on before a sign (client_secret_value=), and a value may stand on the next line, indented, or in the element that the name makes.
VALUE = re.compile(
    r"""((?:[_-][A-Za-z0-9]{1,20}){0,2}["']?[ \t]{0,4}(?:[:=]>?|->)[ \t]{0,4}(?:\r?\n[ \t]{1,16})?|>|["']?\x20is:?\x20|["']?\x20)(?:(?i:bearer|basic)\x20)?(["'`]?)([^\s"'`<>]+)""", re.A
)
QUOTED = re.compile(r"""(["'`])([^"'`\r\n]{8,128})\1""")
#: What stands in code and settings in the place of a value.
ELSEWHERE = re.compile(r"""[a-z][a-z0-9+.-]*://|www\.|\.{0,2}/[\w./-]+$|\$|%[sd({]|\{\{?|[A-Za-z_]+(?:\.[A-Za-z_]+)+(?:$|[\[(])|[A-Za-z_][\w.:]*\(|[A-Za-z_]\w*\[""", re.I | re.A)
NAMED = re.compile(rf"""{NAME}(?:["']?(?:[:=]+>?|->)?[.,;!?)\]}}]*)""", re.A)
HINTS = (b"pass", b"pwd", b"auth", b"kennwort", b"zugangscode", b"geheimnis", "contraseña".encode(), "contraseÑa".encode(), b"contrasena", b"clave", b"mdp", b"jeton", b"secret", b"token", b"credential", b"key", b"bearer")
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
SHORTEST = 8
#: Decimal logarithm of guesses from which a value counts as a secret.
STRONG = 9.0
#: Longest repeated unit that is looked for.
SPAN = 24

#: Common words of passwords, most common first.
WORDS = (
    "password pass admin login welcome master secret dragon monkey shadow sunshine princess football baseball superman batman "
    "iloveyou letmein trustno access flower hello freedom whatever qazwsx starwars computer michael jordan hunter ranger buster "
    "soccer hockey killer george charlie andrew michelle love jessica pepper daniel joshua maggie summer winter spring autumn "
    "ashley nicole chelsea biteme matthew yankees dallas austin thunder taylor matrix mobile cookie chicken test user root guest "
    "default change changeme example sample dummy temp token key server house horse battery staple correct orange apple banana "
    "purple silver golden diamond money cheese coffee tiger eagle falcon phoenix ninja magic lucky happy angel heaven devil"
).split()
#: Characters that stand for letters.
LEET = str.maketrans("4@831!0$57", "aabeiiosst")
#: The rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
#: Guesses, as logarithms: a word of no list, a date, a start in a run or walk.
UNKNOWN_WORD, DATE, START = 5.0, 4.6, 1.5
#: A word of no list costs so much more for each letter beyond 6, and beyond 12.
LONGER, MUCH_LONGER = 0.1, 0.7
DATES = re.compile(r"(?:19|20)\d\d|\d{1,2}[-/.]?\d{1,2}[-/.]?(?:19|20)?\d\d|(?:19|20)\d\d[-/.]?\d{1,2}[-/.]?\d{1,2}", re.A)
LETTERS = re.compile(r"[A-Za-z]{3,}")


@lru_cache(maxsize=1)
def _neighbours() -> dict[str, str]:
    near: dict[str, set[str]] = defaultdict(set)
    for r, row in enumerate(ROWS):
        for c, a in enumerate(row):
            for dr, dc in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)):
                if 0 <= r + dr < len(ROWS) and 0 <= c + dc < len(ROWS[r + dr]):
                    near[a].add(ROWS[r + dr][c + dc])
    return {a: "".join(sorted(b)) for a, b in near.items()}


@lru_cache(maxsize=2)
def _ranks(vocabulary: str) -> tuple[dict[str, float], int]:
    """The logarithm of each word's rank, and the longest word's length."""
    with open(vocabulary, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    known = [t.removesuffix("</w>") for t in sorted(tokens, key=tokens.get) if t.endswith("</w>")]
    words = [*WORDS, *(w for w in known if len(w) >= 3 and w.isascii() and w.isalpha())]
    return {w: math.log10(k + 2) for k, w in reversed([*enumerate(words)])}, max(map(len, words))


def _spans(value: str, vocabulary: str | None = None) -> Iterator[tuple[int, int, float]]:
    """(start, end, guesses) of what is easier than brute force. Linear in the value's length."""
    low = value.lower()
    (ranks, longest), near = _ranks(vocabulary or default_vocabulary()), _neighbours()
    plain = low.translate(LEET)
    for text, extra in ((low, 0.0), (plain, 0.5)) if plain != low else ((low, 0.0),):
        for i in range(len(text)):
            for j in range(i + 3, min(len(text), i + longest) + 1):
                for word, more in ((text[i:j], 0.0), (text[i:j][::-1], 0.3)):
                    if word in ranks:
                        yield i, j, ranks[word] + extra + more + (0.0 if value[i:j].islower() or not value[i:j].isalpha() else 0.5)
    for m in LETTERS.finditer(value):
        word = m[0]
        vowels = sum(c in "aeiouyAEIOUY" for c in word)
        if (word[1:].islower() or word.isupper()) and 0.2 <= vowels / len(word) <= 0.7:
            yield m.start(), m.end(), UNKNOWN_WORD + LONGER * max(0, len(word) - 6) + MUCH_LONGER * max(0, len(word) - 12)
    for i in range(len(value)):
        if (m := DATES.match(value, i)) and m.end() - i >= 4:
            yield i, m.end(), DATE if m.end() - i > 4 else 2.0
    for start, end in _runs(low, lambda a, b: b in near.get(a, "") and a != b):
        yield start, end, START + 0.35 * (end - start)
    for step in (1, -1):
        for start, end in _runs(low, lambda a, b, step=step: ord(b) - ord(a) == step):
            yield start, end, START + 0.1 * (end - start)
    for unit in range(1, min(SPAN, len(value) // 2) + 1):
        i = 0
        while i + 2 * unit <= len(value):
            j = i + unit
            while j < len(value) and value[j] == value[j - unit]:
                j += 1
            if j - i >= max(3, 2 * unit):
                yield i, j, unit * math.log10(_alphabet(value[i : i + unit])) + math.log10((j - i) / unit)
                i = j - unit + 1
            else:
                i += max(1, j - i - unit + 1)


def _runs(text: str, follows) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(text) + 1):
        if i == len(text) or not follows(text[i - 1], text[i]):
            if i - start >= 4:
                yield start, i
            start = i


def _alphabet(text: str) -> int:
    if all(c in "0123456789abcdef" for c in text):
        return 10 if text.isdigit() else 16
    return sum(n for n, has in ((10, any(c.isdigit() for c in text)), (26, any(c.islower() for c in text)), (26, any(c.isupper() for c in text)), (33, any(not c.isalnum() for c in text))) if has)


def guess_cost(value: str, vocabulary: str | None = None) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation of the value takes; 0 for an empty one."""
    if not value:
        return 0.0
    each = math.log10(max(2, _alphabet(value)))
    ends: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for start, end, cost in _spans(value, vocabulary):
        ends[end].append((start, cost))
    joint = 0.3  # each further part could be any of two kinds at least
    best = [0.0]
    brute = math.inf
    for i in range(1, len(value) + 1):
        brute = min(brute, best[i - 1] + joint) + each
        best.append(min([brute, *(best[s] + c + joint for s, c in ends[i])]))
    return max(0.0, best[-1] - joint)


def spans(text: str | None, vocabulary: str | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind, then end; code points."""
    if not text:
        return []
    raw = text.encode()
    low = raw.lower()
    out = []
    if any(h in low for h in ASSIGN_HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in raw.translate(_hex_table()):
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(h in low for h in HINTS):
        done = 0
        for name in CONTEXT.finditer(text):
            # the search goes on right after each name, and beyond values that have been weighed
            if name.start() < done or not (m := VALUE.match(text, name.end())):
                continue
            assigned = m[1].strip("\"'") != " "
            if m[1] == ">" and text[name.start() - 1 : name.start()] != "<":
                continue
            value, start = m[3].rstrip(".,;:!?)]}"), m.start(3)
            # an assigned value may end in = as base64 does; after a bare space a word that does is a name
            if NAMED.fullmatch(m[3]) or (not assigned and m[3][-1] in ":="):
                continue
            if assigned and m[2] and (q := QUOTED.match(text, m.start(2))):
                value = q[2]
            if len(value) < SHORTEST or not (assigned or any(c.isdigit() for c in value)) or ELSEWHERE.match(value):
                continue
            # parts of a value are no stronger than the whole, so each is weighed once
            done = end = start + len(value)
            known = any(a <= start and end <= b for _, a, b in out)
            if not known and guess_cost(value, vocabulary) >= STRONG:
                out.append(("guess", start, end))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@lru_cache(maxsize=1)
def _hex_table() -> bytes:
    return bytes(ord("x") if c in b"0123456789abcdef" else 32 for c in range(256))


def joined(found: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and an array of spans (kind, start, end) for every row, by start, ties by kind, then end.

    vocabulary is the tokenizer's file with ranked words, on every machine.
    Null and empty texts have none. Long texts are scanned whole, in time
    linear in their length. Rows that repeat each give a row; columns beyond
    doc_id and text are not read; an empty table gives no rows.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(text.as_py(), vocabulary)] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """The columns that a query returns for spans: counts of kinds, the hash of the base ones, all of them."""
    text = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    known = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *(number(k) for k in base), F.sha2(text(known), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op7_guess_cost_secrets(spark, sf_dir: str) -> DataFrame:
    return digest(secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")), KINDS[:3])


def sha(found: list[tuple[str, int, int]], base: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(s for s in found if s[0] in base).encode()).hexdigest()
