"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A run of base64 or URL-safe characters that a public tokenizer's vocabulary can only spell in short pieces (few characters
per token) is random text, unless it is a known digest or an identifier.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, place_of, unpacked

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A run is reported if it has so many characters at least and fewer characters per token than this.
LEAST_CHARS, RATIO = 20, 2.4
#: Characters of a run that are encoded at once.
PIECE = 1024

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Digests by length (MD5, SHA-1, SHA-256, SHA-512), UUIDs and numbers.
KNOWN = re.compile(r"([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+)")
APART = re.compile(r"[+/_=-]+")
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Scanner:
    def __init__(self, ranks: dict[bytes, int], least: int = LEAST_CHARS, ratio: float = RATIO):
        import tiktoken

        self.encode, self.least, self.ratio = tiktoken.Encoding("barloom", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, least, ratio

    def base(self, text: str) -> list[tuple[int, int, str]]:
        """(start, place of the kind, end) of the fixed patterns, in order."""
        low = text.lower()
        found = []
        if "pass" in low or "secret" in low or "token" in low or "key" in low:
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def worded(self, run: str) -> bool:
        """Whether run is an identifier in one letter case whose pieces are all words: each reaches the ratio in lower case.
        Pieces of one or two letters can't tell and don't count."""
        parts = [p for p in APART.split(run) if p]
        if not all(map(str.isalpha, parts)) or not (all(map(str.isupper, parts)) or all(p[1:] == p[1:].lower() for p in parts)):
            return False
        pieces = [p.lower() for p in parts if len(p) > 2]
        return bool(pieces) and all(len(p) >= self.ratio * self.tokens(p) for p in pieces)

    def tokens(self, run: str) -> int:
        """Tokens of a run, counted in pieces of PIECE characters, so that the work is linear in its length."""
        return sum(len(self.encode(run[i : i + PIECE])) for i in range(0, len(run), PIECE))

    def random(self, text: str) -> list[tuple[int, int, str]]:
        found = []
        for m in RUN.finditer(text):
            run = m[0]
            if len(run) >= self.least and not KNOWN.fullmatch(run) and len(run) < self.ratio * self.tokens(run) and not self.worded(run):
                found.append((m.start(), 3, m.end()))
        return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(ranks, place: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ranks.value)
        for batch in batches:
            out = []
            for text in batch.column(0).field(place).to_pylist():
                base = scanner.base(text or "")
                spans = sorted(base + scanner.random(text or ""))
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            made = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(made, kinds, strict=True))], ["row", *MADE])

    return scan


MADE = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def _scanned(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))  # a public file of some 50,000 entries
    rows = packed(docs)
    schema = packed(docs).schema
    for name, kind in zip(MADE, ("long", "long", "long", "string", "string"), strict=True):
        schema = schema.add(name, kind)
    return rows.mapInArrow(_scan(ranks, place_of(docs, "text")), schema)


def scan_secrets(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256 (of the fixed patterns' spans) and spans (all, kind:start:end in code points).

    A null text counts as empty. The random spans come from runs of 20 or more characters under 2.4 characters a token that
    are no known digest (hexadecimal of 32, 40, 64 or 128 digits, UUID), number or identifier of plain words in one letter case. Columns
    with the names of the results, in whatever case, are replaced. Repeated rows are answered alike; an empty table gives an empty result.
    """
    return unpacked(_scanned(docs, vocabulary_path), *MADE)


def mask(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """docs with every span of text replaced by [secret]; other columns as given."""
    found = _scanned(docs, vocabulary_path)

    @F.pandas_udf("string")
    def cut(text, spans):
        def one(t, s):
            at, out = 0, []
            for a, b in sorted(tuple(map(int, x.split(":")[1:])) for x in s.split(",") if x):
                if a >= at:
                    out += [t[at:a], "[secret]"]
                at = max(at, b)
            return t if not out else "".join(out) + t[at:]

        import pandas as pd

        return pd.Series([t if t is None else one(t, s) for t, s in zip(text, spans, strict=True)])

    text = cut(F.col("row.text"), "spans")
    return found.select(*(text.alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
