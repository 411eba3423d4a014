"""Operator 1, URL filters: all glob rules at once, bit-parallel.

A rule is a glob over `.host/path` (the host with a dot before it, so that a rule for a host fits its subdomains): `*` stands for any run
without a slash, `**` for any run, `?` for one character that isn't a slash. The rules' symbols lie one after the other in words of 64 bits,
one bit for each place in a rule. A step of the extended Shift-And automaton over the next byte c is

    D = ((D << 1) & reach[c]) | (D & loop[c])

with the carry of the shift going from word to word; a rule fits if its last bit is set at the end of the URL. The automaton runs over all
URLs of a slice side by side (longest first, so that the ones that are over drop out), a byte of each in a step. Of the rules that fit, the
one with the greatest weight wins; of equal weights the first in the list. Where none fits the default verdict holds.

Cases: a null URL, or one without `://`, has empty host and path and gets the default verdict; any length works; no table is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import col, ship, slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    glob: str
    verdict: str
    weight: int
    name: str | None  # as reported; None: a rule of the method, not reported


def prefix_rule(host: str, path: str, verdict: str) -> Rule:
    """A host with its subdomains, and paths that start with `path`; a longer rule has more weight."""
    plain = f"{host}{path}"
    if set(plain) & set("*?"):
        raise ValueError("a prefix rule has no wildcards")
    return Rule(f"*.{plain}**", verdict, 1_000_000 + len(plain), plain)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


class GlobAutomaton:
    def __init__(self, rules: tuple[Rule, ...]):
        symbols: list[tuple[np.ndarray, int]] = []  # (bytes that reach the place, loop: 0 none, 1 without slash, 2 any)
        first, last = [], []
        for rule in rules:
            first.append(len(symbols))
            symbols.append((np.zeros(256, bool), 0))
            glob = rule.glob.encode()
            i = 0
            while i < len(glob):
                c = glob[i : i + 1]
                if c == b"*":
                    loop = 2 if glob[i : i + 2] == b"**" else 1
                    symbols[-1] = (symbols[-1][0], max(loop, symbols[-1][1]))
                    i += loop
                    continue
                takes = np.zeros(256, bool)
                takes[:] = c == b"?"
                takes[glob[i]] = True
                if c == b"?":
                    takes[ord("/")] = False
                symbols.append((takes, 0))
                i += 1
            last.append(len(symbols) - 1)
        self.words = max(1, -(-len(symbols) // 64))
        bits = self.words * 64
        reach, loop = np.zeros((256, bits), bool), np.zeros((256, bits), bool)
        for k, (takes, kind) in enumerate(symbols):
            reach[:, k] = takes
            loop[:, k] = kind > 0
            if kind == 1:
                loop[ord("/"), k] = False
        pack = lambda x: np.packbits(x, axis=-1, bitorder="little").view("<u8")
        self.reach, self.loop = pack(reach), pack(loop)
        start = np.zeros(bits, bool)
        start[first] = True
        self.start = pack(start)
        order = sorted(range(len(rules)), key=lambda r: (-rules[r].weight, r))
        self.last = [(r, last[r] // 64, np.uint64(1) << np.uint64(last[r] % 64)) for r in order]

    def match(self, urls: list[str]) -> np.ndarray:
        """Number of the winning rule for each URL, -1 where none fits."""
        raw = [u.encode("utf-8", "surrogatepass") for u in urls]
        flat = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        at = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        at, size = at[order], size[order]
        state = np.tile(self.start, (len(raw), 1))
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), "left")
        one, top = np.uint64(1), np.uint64(63)
        for step in range(longest):
            n = active[step]
            now, c = state[:n], flat[at[:n] + step]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.reach[c]) | (now & self.loop[c])
        won = np.full(len(raw), -1, np.int64)
        for rule, word, bit in self.last:
            won[(won < 0) & ((state[:, word] & bit) != 0)] = rule
        out = np.empty(len(raw), np.int64)
        out[order] = won
        return out


@lru_cache(4)
def automaton(rules: tuple[Rule, ...]) -> GlobAutomaton:
    return GlobAutomaton(rules)


def judge(df: DataFrame, url_col: str, rules: tuple[Rule, ...], keep: list[str], default: str = "allow") -> DataFrame:
    """The columns `keep`, host, path, rule and verdict of each row."""
    ship(df.sparkSession)
    url = F.col(url_col).cast("string")
    chosen = df.select(host_of(url).alias("__host"), path_of(url).alias("__path"), *(col(k).alias(f"__{i}") for i, k in enumerate(keep)))
    chosen = chosen.select(F.concat(F.lit("."), "__host", "__path").alias("__url"), *chosen.columns)
    names = [*chosen.columns[1:], "__rule", "__verdict"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, urls in slices(batch.column(0)):
                won = automaton(rules).match(urls).tolist()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(start, len(urls)) for i in range(1, batch.num_columns)), pa.array([rules[w].name if w >= 0 else None for w in won], pa.string()), pa.array([rules[w].verdict if w >= 0 else default for w in won], pa.string())], names
                )

    kept = "".join(f"`{n}` {t}, " for n, t in chosen.dtypes[1:])
    out = chosen.mapInArrow(run, f"{kept}__rule string, __verdict string")
    return out.select(*(F.col(f"__{i}").alias(k) for i, k in enumerate(keep)), *(F.col(f"__{k}").alias(k) for k in ("host", "path", "rule", "verdict")))


RULES = (
    prefix_rule("com", "/en/", "block"),
    prefix_rule("example.com", "/en/7", "allow"),
    prefix_rule("net", "/de/", "allow"),
    prefix_rule("example.net", "/de/8", "block"),
    prefix_rule("org", "/es/", "block"),
    Rule("*.spam-farm.**", "block", 1, None),
    Rule("*.cheap-pills.**", "block", 1, None),
)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), "url", RULES, ["page_id"])


OP1_SQL = r"""
with u as (
  select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages
), r as (
  select page_id, host, path, '.' || host as h,
    case when ('.' || host) like '%.example.com' and path like '/en/7%' then 'example.com/en/7'
         when ('.' || host) like '%.example.net' and path like '/de/8%' then 'example.net/de/8'
         when ('.' || host) like '%.com' and path like '/en/%' then 'com/en/'
         when ('.' || host) like '%.net' and path like '/de/%' then 'net/de/'
         when ('.' || host) like '%.org' and path like '/es/%' then 'org/es/' end as rule from u
)
select page_id, host, path, rule,
  case when rule in ('example.com/en/7', 'net/de/') then 'allow' when rule is not null then 'block'
       when h like '%.spam-farm.%' or h like '%.cheap-pills.%' then 'block' else 'allow' end as verdict
from r
"""
