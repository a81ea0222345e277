"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions at its hits, and checksums.

One automaton over all keywords reads every text once. Only at a hit is the expression of the
keyword's kind tried, anchored there, so that the expressions never search. Tokens whose format holds
a checksum or a decodable header count only if it is right. Runs of hexadecimal digits have no
keyword; they are found by their length.

Base kinds: assign, access, hex. Added kinds: github and npm (the last six characters are the CRC-32
of the 30 before, in base 62) and jwt (the first part decodes to a JSON object with "alg").
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import rowmap
from tessera.llm.textblocks import Words, blocks

KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
SPANS = "spans array<struct<kind:string,start:long,end:long>>"
_HEX = np.zeros(256, bool)
_HEX[0x30:0x3A] = _HEX[0x61:0x67] = True
_ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+")
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: bytes) -> bytes:
    """CRC-32 in base 62, six digits."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS[d : d + 1] + out
    return out


def _jwt_header(part: bytes) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


_CHECKED = {"github": (_GITHUB, lambda m: base62_crc(m[1]) == m[2]), "npm": (_NPM, lambda m: base62_crc(m[1]) == m[2]), "jwt": (_JWT, lambda m: _jwt_header(m[1]))}
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",), "jwt": ("eyj",)}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def find_keyed(raw: bytes) -> list[tuple[str, int, int]]:
    """Spans (in bytes) of the kinds that have keywords; of a kind leftmost and without overlap."""
    spans, past = [], dict.fromkeys(KINDS, 0)
    for last, (kind, n) in sorted(_automaton().iter(raw.lower().decode("latin-1")), key=lambda x: x[0] - x[1][1]):
        at = last + 1 - n
        if at < past[kind]:
            continue
        if kind == "assign":
            m = _ASSIGN.match(raw, at)
            good = m and len(m[1]) >= 12
        elif kind == "access":
            m = _ACCESS.match(raw, at)
            good = m and len(m[0]) >= 18
        else:
            expression, valid = _CHECKED[kind]
            m = expression.match(raw, at)
            good = m and valid(m)
        if m:
            past[kind] = m.end()
        if good:
            spans.append((kind, m.start(), m.end()))
    return spans


def _batch_spans(texts: pa.Array) -> list[list[tuple[str, int, int]]]:
    """Spans of each text in bytes, by start and then kind."""
    out: list[list] = []
    for block in blocks(texts):
        runs = Words(block, _HEX)
        long = np.flatnonzero(runs.ends - runs.starts >= 16)
        hexes: dict[int, list] = {}
        for i in long.tolist():
            row = int(runs.rows[i])
            low = int(block.offsets[row])
            hexes.setdefault(row, []).append(("hex", int(runs.starts[i]) - low, int(runs.ends[i]) - low))
        for row in range(block.rows):
            spans = find_keyed(block.text(row)) + hexes.get(row, [])
            out.append(sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))) if len(spans) > 1 else spans)
    return out


def _in_characters(raw: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if not spans or raw.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(k, int(before[s]), int(before[e])) for k, s, e in spans]


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs with `spans`: kind, start and end (code points, end exclusive) of each secret, by start and then kind.

    A null or empty text has none; a text is read whole, however long; repeated rows get the same
    spans; an empty table stays empty; a column of docs named spans, in any case, is replaced.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        rows = []
        for text, spans in zip(texts, _batch_spans(texts), strict=True):
            spans = _in_characters(text.as_py().encode(), spans) if spans else spans
            rows.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
        return [pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]

    return rowmap.with_columns_from_text(docs, SPANS, compute)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with each secret of their text replaced by the mark; overlapping spans become one mark.

    All columns stay as they are, whatever their names, but for text. A null text stays null, an empty
    one empty; a text is read whole; repeated rows are redacted alike; an empty table stays empty. What
    is left where a secret was is not looked at again.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        rows = []
        for text, spans in zip(texts, _batch_spans(texts), strict=True):
            if not spans:
                rows.append(text.as_py())
                continue
            raw, at, out = text.as_py().encode(), 0, []
            for _, s, e in spans:
                if s >= at:
                    out += [raw[at:s], mark.encode()]
                at = max(at, e)
            rows.append(b"".join([*out, raw[at:]]).decode())
        return [pa.array(rows, pa.string())]

    own, back = rowmap.set_aside(docs)
    return back(rowmap.with_columns_from_text(own, "text string", compute))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(rowmap.documents(spark, sf_dir))
    count = lambda kind: F.expr(f"cast(size(filter(spans, x -> x.kind = '{kind}')) as long)").alias(f"n_{kind}")
    listed = lambda spans: f"concat_ws(',', transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)))"
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.expr(listed("filter(spans, x -> x.kind in ('assign', 'access', 'hex'))")), 256).alias("base_sha256"), F.expr(listed("spans")).alias("spans"))
