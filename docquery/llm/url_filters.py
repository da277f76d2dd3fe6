"""URL filters by a bit-parallel automaton that runs all glob rules at once.

A canonical URL is "." + host + path, the host's A-Z in lower case. Globs have
`*` for any run without "/", `**` for any run, `?` for one character other
than "/"; all else stands for itself. All rules lie side by side in 64-bit
words, one bit per state; a byte moves every rule of every URL of a batch with
a few operations per word (Shift-And with self-loops for wildcards). Of the
rules that match a whole URL, the one with the longest name decides, the first
of equals; where none matches, the verdict is `default`.

Null URLs and those without "://" have empty host and path. Every row is
judged, repeated ones alike.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.batches import map_rows

U = np.uint64
#: (verdict, host, path) of the contract's rules, fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_glob(host: str, path: str) -> str:
    """The host and its subdomains, with paths that start so."""
    return f"*.{host}{path}**"


class Automaton:
    """Masks of glob rules over 64-bit words: per byte, the states that advance and those that stay."""

    def __init__(self, globs: Sequence[str]):
        self.rules, start, last = len(globs), [], []
        advance, stay, at = [], [], 0
        slash, every = np.arange(256) == ord("/"), np.ones(256, bool)
        for glob in globs:
            start.append(at)
            loop = np.zeros(256, bool)
            data, i = glob.encode(), 0
            while i < len(data):
                if data[i : i + 2] == b"**":
                    loop, i = every, i + 2
                elif data[i : i + 1] == b"*":
                    loop, i = loop | ~slash, i + 1
                else:
                    advance.append(~slash if data[i : i + 1] == b"?" else np.arange(256) == data[i])
                    stay.append(loop)
                    loop, i, at = np.zeros(256, bool), i + 1, at + 1
            advance.append(np.zeros(256, bool))
            stay.append(loop)
            last.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.advance, self.stay = self._pack(advance, at), self._pack(stay, at)
        self.start = np.zeros(self.words, np.uint64)
        for s in start:
            self.start[s // 64] |= U(1) << U(s % 64)
        self.last = [(s // 64, U(s % 64)) for s in last]

    def _pack(self, rows: list[np.ndarray], n: int) -> np.ndarray:
        out = np.zeros((256, self.words), np.uint64)
        for s in range(n):
            out[:, s // 64] |= rows[s].astype(np.uint64) << U(s % 64)
        return out

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """texts x rules: whether the rule matches the whole text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        state = np.tile(self.start, (len(texts), 1))
        for t in range(int(sizes[0]) if len(sizes) else 0):
            alive = int(np.searchsorted(-sizes, -t, side="left"))
            byte = flat[begin[:alive] + t]
            moved = state[:alive] & self.advance[byte]
            carry = moved >> U(63)
            state[:alive] &= self.stay[byte]
            state[:alive] |= moved << U(1)
            state[:alive, 1:] |= carry[:, :-1]
        out = np.zeros((len(texts), self.rules), bool)
        for r, (word, bit) in enumerate(self.last):
            out[order, r] = (state[:, word] >> bit & U(1)).astype(bool)
        return out


def host_of(url: str) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(F.col(url), F.instr(url, "://") + 3)).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(F.col(url), F.instr(url, "://") + 3)).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)\A[^/?#]*([^?#]*)", 1)


def _judge(batches: Iterator[pd.DataFrame], rules: list[tuple[str, str, str]], default: str) -> Iterator[pd.DataFrame]:
    automaton = Automaton([glob for _, _, glob in rules])
    by_length = sorted(range(len(rules)), key=lambda r: (-len(rules[r][1]), r))
    names = np.array([*(rules[r][1] for r in by_length), None], object)
    verdicts = np.array([*(rules[r][0] for r in by_length), default], object)
    for batch in batches:
        hit = automaton.matches([("." + h + p).encode() for h, p in zip(batch["host"], batch["path"], strict=True)])[:, by_length]
        which = np.where(hit.any(axis=1), hit.argmax(axis=1), len(rules)) if len(rules) else np.zeros(len(batch), int)
        yield batch.assign(rule=names[which], verdict=verdicts[which])


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row; rules are (verdict, name, glob)."""
    split = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    return map_rows(split, functools.partial(_judge, rules=list(rules), default=default), "page_id long, host string, path string, rule string, verdict string", "page_id")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(verdict, host + path, host_glob(host, path)) for verdict, host, path in RULES]
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
