"""Operator 9: URL rules by a bit-parallel wildcard automaton.

All glob rules are packed into one row of 64-bit words, a bit per literal and a bit before each rule's first. A byte of
a URL moves every rule at once: the bits shift by one where the byte fits the next literal, and stay where a wildcard
stands that takes the byte. URLs are stepped column by column, so that each step handles one byte of all of them; as many
are taken at a time as their states have room in STATE_WORDS. A task makes the automaton once. URLs are judged as ``.host/path``: the dot lets a rule for a host fit its subdomains as well.

Globs: ``*`` takes any bytes but a slash, ``**`` any bytes, ``?`` one byte but a slash; all else is literal.

A null URL, or one without ``://``, has an empty host and path, no base rule, and the verdict of the globs on ``.``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import LOWER, per_slice, table, texts_of

#: (host, path, verdict): the rule fits the host and its subdomains where the path starts with the rule's; longest wins.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

#: URLs that no rule fits are blocked by these globs, and allowed otherwise.
BLOCK = [
    ".ad.**", ".ads.**", "*.ads.**", "*.adserver.**", "*.tracker.**", "*.click.**",
    "*casino*/**", "*poker*/**", "*porn*/**", "**/login", "**/login/**", "**/signin/**", "**/cart/**", "**/cgi-bin/**", "**/wp-admin/**",
    "**.exe", "**.zip", "**.iso", "**.apk", "**.dmg",
]


#: Words of 64 bits that the states of the URLs of one step have, at most, unless one URL's has more.
STATE_WORDS = 1 << 21


class GlobAutomaton:
    def __init__(self, globs: list[str]):
        tokens = [re.findall(r"\*\*|.", g, re.S) for g in globs]
        size = sum(1 + sum(len(t.encode()) for t in ts if t[0] != "*") for ts in tokens)
        self.words = max(1, -(-size // 64))
        self.first = np.zeros(self.words, np.uint64)
        self.moves = np.zeros((256, self.words), np.uint64)
        self.stays = np.zeros((256, self.words), np.uint64)
        self.ends: list[tuple[int, np.uint64]] = []
        bit, every, no_slash = -1, np.arange(256), np.delete(np.arange(256), ord("/"))
        for ts in tokens:
            bit += 1
            self.first[bit // 64] |= np.uint64(1 << bit % 64)
            for t in ts:
                if t[0] == "*":
                    self.stays[every if t == "**" else no_slash, bit // 64] |= np.uint64(1 << bit % 64)
                    continue
                for byte in [no_slash] if t == "?" else t.encode():
                    bit += 1
                    self.moves[byte, bit // 64] |= np.uint64(1 << bit % 64)
            self.ends.append((bit // 64, np.uint64(bit % 64)))

    def match(self, urls: list[bytes]) -> np.ndarray:
        """Which globs (columns) fit which URLs (rows)."""
        size = max(1, STATE_WORDS // self.words)
        return np.concatenate([self._matched(urls[k : k + size]) for k in range(0, len(urls), size)] or [np.zeros((0, len(self.ends)), bool)])

    def _matched(self, urls: list[bytes]) -> np.ndarray:
        lengths = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-lengths, kind="stable")  # those that still run come first
        data = np.frombuffer(b"".join(urls), np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        falling = lengths[order]
        now = np.tile(self.first, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        for k in range(int(falling[0]) if len(urls) else 0):
            live = int(np.searchsorted(-falling, -k, "left"))
            byte, state = data[begin[:live] + k], now[:live]
            moved = state << one
            moved[:, 1:] |= state[:, :-1] >> top
            now[:live] = (moved & self.moves[byte]) | (state & self.stays[byte])
        out = np.zeros((len(urls), len(self.ends)), bool)
        for g, (word, bit) in enumerate(self.ends):
            out[order, g] = (now[:, word] >> bit) & one == one
        return out


def parts(url: bytes) -> tuple[bytes, bytes]:
    """Host and path."""
    at = url.find(b"://")
    if at < 0:
        return b"", b""
    rest = re.split(rb"[?#]", url[at + 3 :], maxsplit=1)[0]
    slash = rest.find(b"/")
    return (rest, b"") if slash < 0 else (rest[:slash], rest[slash:])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], block: list[str], url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to the columns of ``pages``; a map without a shuffle. Hosts and
    paths of ``rules`` are literal."""
    names = ["host", "path", "rule", "verdict"]
    pages = pages.drop(*(c for c in pages.columns if c.lower() in names))
    if any(set("*?") & set(host + path) for host, path, _ in rules):
        raise ValueError("hosts and paths of rules have no wildcards")
    rules = sorted(rules, key=lambda r: len(r[0] + r[1]))  # a longer one overrides
    globs = [f"*.{host}{path}**" for host, path, _ in rules] + block
    made: list[GlobAutomaton] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(GlobAutomaton(globs))
        split = [(host.translate(LOWER), path) for host, path in map(parts, texts_of(batch, url))]
        fits = made[0].match([b"." + host + path for host, path in split])
        which = np.full(len(split), -1)
        for k in range(len(rules)):
            which[fits[:, k]] = k
        blocked = fits[:, len(rules) :].any(axis=1)
        rule = [rules[k][0] + rules[k][1] if k >= 0 else None for k in which]
        verdict = [rules[k][2] if k >= 0 else "block" if b else "allow" for k, b in zip(which, blocked, strict=True)]
        new = [[h.decode() for h, _ in split], [p.decode() for _, p in split], rule, verdict]
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in new)], names=[*batch.schema.names, *names])

    return per_slice(pages, url, work, T.StructType([*pages.schema.fields, *(T.StructField(n, T.StringType()) for n in names)]))


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, BLOCK).drop("url")


def _pattern(glob: str) -> str:
    return "".join({"**": "(.|\\n)*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|.", glob, re.S))


_FITS = " ".join(
    f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{{}}'".replace("{}", f"{host}{path} {verdict}")
    for host, path, verdict in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
)
ORACLE_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://(.*)$', 1) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
     f AS (SELECT *, CASE {_FITS} END AS fit, regexp_full_match('.' || host || path, '{"|".join(map(_pattern, BLOCK))}') AS blocked FROM p)
SELECT page_id, host, path, split_part(fit, ' ', 1) AS rule, coalesce(split_part(fit, ' ', 2), CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict FROM f
"""
