"""URL filters: one bit-parallel automaton for all wildcard rules.

Rules are globs over the canonical URL, which is a dot, the host in lower case,
and the path. ``*`` stands for any characters of one side of the host's end (it
passes no ``/``), ``**`` for any characters, ``?`` for one that is not ``/``.
Every state of every rule is a bit of a few machine words. One step of
Shift-And, with a mask of the states that a wildcard lets stay, moves all rules
at once over the next character, for a whole batch of URLs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticevec.llm.common import utf8

#: What hosts of spam are named by; such hosts are blocked where no rule says otherwise.
SPAM = ["casino", "free-bets", "poker", "viagra", "ads-track", "porn", "xxx-"]

#: Bytes of states that are held at once.
STATE_BYTES = 1 << 24


@dataclass(frozen=True)
class Rule:
    """Allow or block a host with its subdomains, if the path starts with the rule's."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


#: The rules of the query; the longest that fits wins.
RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]


class Globs:
    """Shift-And masks of any number of globs."""

    def __init__(self, globs: list[str]):
        n, begin, accept = 0, [], []  # states
        into: list[tuple[int, int]] = []  # (state, byte that leads to it)
        stay: list[tuple[int, bool]] = []  # (state, whether it stays over every byte)
        for glob in globs:
            begin.append(n)
            data, k = glob.encode(), 0
            while k < len(data):
                if data[k : k + 2] == b"**":
                    stay.append((n, True))
                    k += 2
                elif data[k : k + 1] == b"*":
                    stay.append((n, False))
                    k += 1
                else:
                    n += 1
                    into.append((n, data[k]))
                    k += 1
            accept.append(n)
            n += 1
        self.width = -(-max(1, n) // 64)
        self.move, self.stay = np.zeros((256, self.width), np.uint64), np.zeros((256, self.width), np.uint64)
        slash = np.arange(256) == ord("/")
        for state, byte in into:
            rows = ~slash if byte == ord("?") else np.arange(256) == byte
            self.move[rows, state >> 6] |= np.uint64(1 << (state & 63))
        for state, everywhere in stay:
            self.stay[slice(None) if everywhere else ~slash, state >> 6] |= np.uint64(1 << (state & 63))
        self.start, self.final = np.zeros(self.width, np.uint64), np.zeros(self.width, np.uint64)
        for where, states in ((self.start, begin), (self.final, accept)):
            for s in states:
                where[s >> 6] |= np.uint64(1 << (s & 63))
        self.rule = np.full(self.width * 64, -1)
        self.rule[accept] = np.arange(len(globs))

    def match(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, glob) for each glob that matches a whole text; so many texts at a time as bound the states' memory."""
        step = max(1, STATE_BYTES // (8 * self.width))
        found = [self._match(texts[a : a + step]) for a in range(0, len(texts), step)] or [(np.zeros(0, int), np.zeros(0, int))]
        return np.concatenate([row + k * step for k, (row, _) in enumerate(found)]), np.concatenate([glob for _, glob in found])

    def _match(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        at = (np.cumsum(lengths) - lengths)[order]
        longest = -np.sort(-lengths)
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for p in range(int(longest[0]) if len(texts) else 0):
            k = int(np.searchsorted(-longest, -p))  # texts longer than p
            now, byte = state[:k], flat[at[:k] + p]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:k] = (moved & self.move[byte]) | (now & self.stay[byte])
        bits = np.unpackbits((state & self.final).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        return order[row], self.rule[bit]


def host_and_path(url: str) -> tuple[Column, Column]:
    """The host, between the first :// and the next / ? # or the end, with A-Z lower-cased, and the path, from there to ? # or the end; both empty without ://."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    part = lambda k: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), upper, lower), part(2)


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[Rule] = RULES, spam: list[str] = SPAM) -> DataFrame:
    """One row per page: page_id, host, path, rule (of the longest that fits, else null), verdict (its own; else block for hosts of spam, else allow).

    Of rules equally long one that blocks wins, then the earlier. Null URLs and
    those without :// have an empty host and path and fit no rule. Repeated rows
    and rows without an id stay; other columns are ignored.
    """
    order = sorted(range(len(rules)), key=lambda k: (len(rules[k].name), rules[k].verdict == "block", -k))
    ranked = [rules[k] for k in order]
    globs = Globs([r.glob for r in ranked] + [f"*{s}**" for s in spam])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"." + h + p for h, p in zip(utf8(batch.column(1)), utf8(batch.column(2)), strict=True)]
            best, bad = np.full(len(texts), -1), np.zeros(len(texts), bool)
            row, glob = globs.match(texts)
            own = glob < len(ranked)
            np.maximum.at(best, row[own], glob[own])
            bad[row[~own]] = True
            names = [ranked[b].name if b >= 0 else None for b in best]
            verdicts = [ranked[b].verdict if b >= 0 else "block" if x else "allow" for b, x in zip(best, bad, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    host, path = host_and_path(url)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return rows.mapInArrow(scan, "page_id long, host string, path string, rule string, verdict string")


_FITS = lambda r: f"(suffix('.' || host, '.{r.host}') AND starts_with(path, '{r.path}'))"
_RANKED = sorted(RULES, key=lambda r: (-len(r.name), r.verdict == "allow"))
#: DuckDB SQL for the rows of ``judge`` over a table ``pages``.
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_FITS(r)} THEN '{r.name}'" for r in _RANKED)} END AS rule,
  CASE {" ".join(f"WHEN {_FITS(r)} THEN '{r.verdict}'" for r in _RANKED)} WHEN {" OR ".join(f"contains(host, '{s}')" for s in SPAM)} THEN 'block' ELSE 'allow' END AS verdict
FROM p
"""
