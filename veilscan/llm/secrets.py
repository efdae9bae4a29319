r"""Secrets: an Aho-Corasick automaton finds keywords, patterns run anchored at the hits alone, checksums confirm.

Base kinds are assign, access and hex; hex has no keyword, its runs are searched for as they are. The method adds
tokens that carry proof of themselves: github (six base-62 digits of a CRC-32 over the rest), npm (the same), jwt (a
header that decodes to a JSON object with an algorithm), pem (a block whose Base64 decodes to DER), and provider keys of fixed
shape (google, slack, stripe).

Edge cases: a null text is the empty text; equal rows give equal results; ids may repeat or be null; an empty table gives
an empty result; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from .common import blocks, read_table, slices

KINDS = ["assign", "access", "hex", "github", "npm", "jwt", "pem", "google", "slack", "stripe"]
ORDER = {k: i for i, k in enumerate(KINDS)}
HEX = re.compile(r"[0-9a-f]{24,}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int) -> str:
    out = ""
    while n or not out:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(width, "0")


def _crc_ok(m: re.Match) -> bool:
    body = m.group(1)
    return base62(zlib.crc32(body[:-6].encode()), 6) == body[-6:]


def _jwt_ok(m: re.Match) -> bool:
    head = m.group().split(".")[0]
    try:
        told = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):  # no Base64, no JSON, or JSON nested beyond any header
        return False
    return isinstance(told, dict) and "alg" in told


def _pem_ok(m: re.Match) -> bool:
    try:
        der = base64.b64decode("".join(m.group(1).split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    return der[:1] == b"\x30" or der.startswith(b"openssh-key-v1")


#: Keyword in lower case: (kind, anchored pattern, what a match must fulfil). A match that fails still uses up its text.
_ASSIGN = (
    "assign",
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    lambda m: len(m.group(2)) >= 6,
)
RULES = {
    **dict.fromkeys(["password", "passwd", "secret", "token", "apikey", "api_key"], [_ASSIGN]),
    "akia": [("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20)],
    **dict.fromkeys(["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], [("github", re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_ok)]),
    "npm_": [("npm", re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_ok)],
    "eyj": [("jwt", re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), _jwt_ok)],
    "-----begin": [("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END [A-Z ]*PRIVATE KEY-----"), _pem_ok)],
    "aiza": [("google", re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"), lambda m: True)],
    "xox": [("slack", re.compile(r"xox[abprs]-[0-9]+-[A-Za-z0-9-]{10,}"), lambda m: True)],
    **dict.fromkeys(["sk_live_", "rk_live_"], [("stripe", re.compile(r"[sr]k_live_[A-Za-z0-9]{24,}"), lambda m: True)]),
}

_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word in RULES:
            a.add_word(word, word)
        a.make_automaton()
        _automaton = a
    return _automaton


def scan(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) by start, then kind."""
    # lower() on bytes changes A-Z alone; offsets are of bytes then, and differ from code points only with other letters
    raw = text.encode("utf-8", "surrogatepass")
    wide = len(raw) != len(text)
    hits: dict[str, set[int]] = {}
    for end, word in automaton().iter(raw.lower().decode("latin-1")):
        for rule in RULES[word]:
            hits.setdefault(rule[0], set()).add(end + 1 - len(word))
    out = []
    for kind, starts in hits.items():
        _, pattern, holds = next(r for rules in RULES.values() for r in rules if r[0] == kind)
        used = at_byte = at = 0
        for start in sorted(starts):
            if wide:  # code points, counted on from the hit before
                at += len(raw[at_byte:start].decode("utf-8", "surrogatepass"))
                at_byte, start = start, at
            if start >= used and (m := pattern.match(text, start)):
                used = m.end()
                if holds(m):
                    out.append((m.start(), m.end(), kind))
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]], s[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            for texts, ids in blocks(b.column(1).to_pylist(), b.column(0).to_pylist()):
                rows = [scan(t or "") for t in texts]
                base = [[s for s in r if ORDER[s[2]] < 3] for r in rows]
                counts = [pa.array([sum(s[2] == k for s in r) for r in base], pa.int64()) for k in KINDS[:3]]
                digests = pa.array([sha256(listed(r).encode()).hexdigest() for r in base], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *counts, digests, pa.array([listed(r) for r in rows], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(read_table(spark, sf_dir, "documents"))
