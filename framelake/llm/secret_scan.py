"""Secret scans: an Aho-Corasick automaton finds keywords, regular expressions run anchored at its hits, checksums confirm.

Base kinds: assign, access, hex. Kinds the method adds, kept only if what is embedded in them checks out:
github and npm (six base-62 digits hold the CRC-32 of the thirty characters before), jwt (header decodes to JSON with alg).
Null and empty texts give no spans. Time is linear in a text, whatever is in it, and a header nested too deep to decode is no token.
Rows are treated one by one: repeats give repeats, other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import kept, table

KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt",
}
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "github": r"gh[pousr]_[0-9A-Za-z]+",
    "npm": r"npm_[0-9A-Za-z]+",
    "jwt": r"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++",
}
#: A run of 24 is wholly found by looking for 24 or more: a run's first place is always tried first.
HEX = r"[0-9a-f]{24,}"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int = 6) -> str:
    out = ""
    for _ in range(width):
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
    return out


def sound(kind: str, m: re.Match) -> bool:
    """Length rules of the base kinds; embedded checks of the others."""
    if kind == "assign":
        return len(m[2]) >= 6
    if kind == "access":
        return len(m[0]) >= 20
    if kind in ("github", "npm"):
        body = m[0][4:]
        return len(body) == 36 and base62(zlib.crc32(body[:30].encode())) == body[30:]
    head = m[0].split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError):  # the last from brackets nested too deep
        return False


def scanner():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton, {k: re.compile(p, re.ASCII) for k, p in PATTERNS.items()}, re.compile(HEX), re.compile(r"[A-Za-z0-9_-]*")


def spans(text: str | None, tools=None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS; code points, end exclusive."""
    if not text:
        return []
    automaton, patterns, hexes, run = tools or kept("secret_scanner", scanner)
    # Only A-Z are lowered, so that places stay those of the text.
    low = text.lower() if text.isascii() else text.encode().lower().decode()
    hits: dict[str, list[int]] = {}
    for end, (kind, size) in automaton.iter(low):
        hits.setdefault(kind, []).append(end - size + 1)
    found = [("hex", m.start(), m.end()) for m in hexes.finditer(text)]
    for kind, starts in hits.items():
        free = 0
        for at in sorted(starts):
            if at < free:
                continue
            if m := patterns[kind].match(text, at):
                free = m.end()
                if sound(kind, m):
                    found.append((kind, m.start(), m.end()))
            elif kind == "jwt":  # all hits in this run have the same end, and none is a token
                free = run.match(text, at).end()
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, kind, start, end, value) for each secret: the operator's general form."""

    def run(frames: Iterator):
        import pandas as pd

        tools = kept("secret_scanner", scanner)
        for f in frames:
            rows = [(k, *s, t[s[1] : s[2]]) for k, t in zip(f["k"], f["t"], strict=True) for s in spans(t, tools)]
            yield pd.DataFrame(rows, columns=["k", "kind", "start", "end", "value"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null").mapInPandas(run, f"k {kind}, kind string, start long, end long, value string").withColumnRenamed("k", key)


def digest(docs: DataFrame) -> DataFrame:
    """A row for each document: counts of the base kinds, their digest, all spans."""

    def run(frames: Iterator):
        import pandas as pd

        tools = kept("secret_scanner", scanner)
        join = lambda found: ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        for f in frames:
            rows = []
            for doc, t in zip(f["d"], f["text"], strict=True):
                found = spans(t, tools)
                base = [s for s in found if s[0] in KINDS[:3]]
                n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                rows.append((doc, *n, hashlib.sha256(join(base).encode()).hexdigest(), join(found)))
            yield pd.DataFrame(rows, columns=["d", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    # The id travels as text: pandas would turn longs with nulls into doubles.
    rows = docs.select(F.col("doc_id").cast("string").alias("d"), "text").mapInPandas(run, "d string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return rows.select(F.col("d").cast("long").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
