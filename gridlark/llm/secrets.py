"""Secret scan: fixed patterns, and strings that a tokenizer can't spell with few tokens.

A vocabulary learned from text spells words with long tokens; a random string falls apart into short ones. So a long
string of key-like characters with few characters per token is taken for a secret, unless it is a known kind of digest
or identifier. The patterns (an assignment to a secret's name, an access key, a long hexadecimal run) are kept as
they are; the token test adds its own spans.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.llm.support import slices

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "token")
#: Characters per token up to which a string counts as random; English text has about four.
LEAST_RATIO = 1.9
#: Characters that a string needs before its ratio says anything.
LEAST_CHARS = 20
#: Characters of a string that are encoded at once; longer strings are summed over such pieces.
_PIECE = 2000

# The three patterns and their least lengths.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_NAMES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 and more

_STRING = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.IGNORECASE)
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z", re.IGNORECASE)
_NUMBERS = re.compile(r"[0-9]+(?:[+/_=-]+[0-9]+)*[+/_=-]*\Z")

FOUND = "n_assign long, n_access long, n_hex long, n_token long, found array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_FOUND_ARROW = [pa.int64()] * 4 + [pa.list_(_SPAN)]


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """The tiktoken encoding of a file of ranks; one for each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns: leftmost, not overlapping within a kind, those that are too short left out."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def known_kind(string: str) -> bool:
    """Digests of the usual lengths, UUIDs, and identifiers of digits only. Letters are left to the ratio."""
    return bool(_DIGEST.match(string) or _UUID.match(string) or _NUMBERS.match(string))


def token_spans(text: str, encoding) -> list[tuple[str, int, int]]:
    """Long strings with few characters per token."""
    out = []
    for m in _STRING.finditer(text):
        if not known_kind(m[0]):
            pieces = (m[0][i : i + _PIECE] for i in range(0, len(m[0]), _PIECE))
            if len(m[0]) <= LEAST_RATIO * sum(len(encoding.encode_ordinary(p)) for p in pieces):
                out.append(("token", m.start(), m.end()))
    return out


def spans_of(text: str, encoding) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed. Offsets count code points; the end is exclusive."""
    return sorted(base_spans(text) + token_spans(text, encoding), key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every maximal covered stretch replaced by ``mark``."""
    out, done = [], 0
    for _, start, end in spans:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])


def scan(df: DataFrame, path: str, text: str = "text", prefix: str = "", redacted: bool = False) -> DataFrame:
    """All rows and columns of ``df`` with n_assign, n_access, n_hex, n_token and ``found``, the spans.

    ``path`` is a file of tiktoken ranks. ``prefix`` goes before the new names, for inputs that have such columns. With
    ``redacted`` the text column has its secrets replaced. Null text has no spans and stays null; repeated rows are
    judged alike.
    """
    new = [T.StructField(prefix + f.name, f.dataType) for f in T._parse_datatype_string(FOUND).fields]
    out = T.StructType([*df.schema.fields, *new])
    place = df.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(path)
        for batch in slices(batches, text):
            texts = batch.column(place).to_pylist()
            found = [spans_of(t, encoding) if t else [] for t in texts]
            rows = [[*(sum(s[0] == k for s in f) for k in KINDS), [dict(zip(("kind", "start", "end"), s)) for s in f]] for f in found]
            columns = list(batch.columns)
            if redacted:
                columns[place] = pa.array([redact(t, f) if f else t for t, f in zip(texts, found)], columns[place].type)
            new = [pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * 5, _FOUND_ARROW)]
            yield pa.RecordBatch.from_arrays(columns + new, names=[f.name for f in out.fields])

    return df.withColumn(text, F.col(text).cast("string")).mapInArrow(judge, out)


def listing(found, kinds: tuple[str, ...] = KINDS):
    """kind:start:end of the spans of these kinds, comma-joined, as a Column."""
    kept = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
