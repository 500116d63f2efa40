"""URL rules by a bit-parallel wildcard automaton (Shift-And).

A rule is turned into globs over the canonical URL (host, a zero byte, path): ``*`` stands
for any bytes but the zero byte, ``**`` for any bytes.  All globs are packed into one mask
of several 64-bit words: bit 0 of a glob is its start, bit i means that i characters are
matched.  A byte ``c`` moves all globs of all URLs of a batch at once,
``D = ((D << 1) & NEXT[c]) | (D & LOOP[c])``, where ``LOOP`` keeps states whose star takes ``c``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataquarry.llm.common import fresh, lower_ascii

#: Bytes of a batch of URLs that move together.
BATCH_BYTES = 8_000_000


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, paths that begin with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        plain = f"{self.host}\0{self.path}**"
        return plain, f"*.{plain}"


#: The rules of the registered query (fixed values).
RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)


class Automaton:
    """Masks of a list of globs; ``match`` gives a row of bits per URL and a column per glob."""

    def __init__(self, globs: Sequence[str]):
        nexts: dict[int, list[int]] = {}
        loops, starts, ends = [], [], []
        at = 0
        for glob in globs:
            starts.append(at)
            rest = glob.encode()
            while rest:
                if rest.startswith(b"**"):
                    loops.append((at, True))
                    rest = rest[2:]
                elif rest.startswith(b"*"):
                    loops.append((at, False))
                    rest = rest[1:]
                else:
                    nexts.setdefault(rest[0], []).append(at + 1)
                    at, rest = at + 1, rest[1:]
            ends.append(at)
            at += 1
        self.words = -(-at // 64)
        self.next = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        for byte, bits in nexts.items():
            for bit in bits:
                self.next[byte, bit // 64] |= np.uint64(1 << (bit % 64))
        for bit, all_bytes in loops:
            self.loop[slice(0 if all_bytes else 1, 256), bit // 64] |= np.uint64(1 << (bit % 64))
        self.start = np.zeros(self.words, np.uint64)
        for bit in starts:
            self.start[bit // 64] |= np.uint64(1 << (bit % 64))
        self.ends = ends

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        sizes = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-sizes, kind="stable")
        out = np.zeros((len(urls), len(self.ends)), bool)
        begin = 0
        while begin < len(order):
            end, total = begin, 0
            while end < len(order) and (end == begin or total + sizes[order[end]] <= BATCH_BYTES):
                total += sizes[order[end]]
                end += 1
            part = order[begin:end]
            out[part] = self._run([urls[i] for i in part], sizes[part])
            begin = end
        return out

    def _run(self, urls: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """URLs in order of falling length: at each place a leading part of them is still alive."""
        text = np.frombuffer(b"".join(urls), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        state = np.tile(self.start, (len(urls), 1))
        alive = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")
        for place, n in enumerate(alive):
            bytes_ = text[offsets[:n] + place]
            d = state[:n]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.next[bytes_]) | (d & self.loop[bytes_])
        return np.stack([(state[:, e // 64] >> np.uint64(e % 64)) & np.uint64(1) for e in self.ends], axis=1).astype(bool)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matcher(rules: Sequence[Rule]):
    """A column function: host and path to the number of the winning rule, or null.

    The longest rule wins; of equally long ones that with the longer host, then the first.
    """
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), -len(rules[i].host), i))
    globs = [g for rule in rules for g in rule.globs()]

    @F.pandas_udf("int")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        automaton = Automaton(globs)
        for hosts, paths in batches:
            # A zero byte in a host would look like its end.
            urls = [f"{h.replace(chr(0), chr(1))}\0{p}".encode("utf-8", "surrogatepass") for h, p in zip(hosts, paths)]
            found = automaton.match(urls)
            best = np.full(len(urls), -1, np.int32)
            for rule in reversed(ranked):
                best[found[:, 2 * rule] | found[:, 2 * rule + 1]] = rule
            yield pd.Series(best).astype("Int32").where(lambda s: s >= 0, pd.NA)

    return match


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns with ``host``, ``path``, ``rule`` and ``verdict``, which replace columns of those names.

    A URL that no rule fits gets the default verdict; a null URL has an empty host and path.
    """
    kept = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url])
    host, path, number = fresh(kept, "_host", "_path", "_rule")
    rows = kept.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    if not rules:
        rows, rules = rows.withColumn(number, F.lit(None).cast("int")), (Rule(default, "", ""),)
    else:
        rows = rows.withColumn(number, matcher(rules)(host, path))
    names, actions = F.array(*[F.lit(r.name) for r in rules]), F.array(*[F.lit(r.action) for r in rules])
    return rows.select(
        *[F.col(f"`{c}`") for c in kept.columns], F.col(host).alias("host"), F.col(path).alias("path"),
        F.get(names, F.col(number)).alias("rule"), F.coalesce(F.get(actions, F.col(number)), F.lit(default)).alias("verdict"),
    )


def judge_sql(rules: Sequence[Rule] = RULES, default: str = "allow") -> str:
    """The same in SQL."""
    values = ", ".join(f"('{r.action}', '{r.host}', '{r.path}', {len(r.name)}, {len(r.host)}, {i})" for i, r in enumerate(rules))
    return f"""with cut as (select page_id,
      translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
    hit as (select c.*, r.* from cut c left join (values {values}) as r(action, rhost, rpath, size, hsize, n)
      on (c.host = rhost or ends_with(c.host, '.' || rhost)) and starts_with(c.path, rpath))
    select page_id, host, path, arg_min(rhost || rpath, [-size, -hsize, n]) as rule,
      coalesce(arg_min(action, [-size, -hsize, n]), '{default}') as verdict
    from hit group by page_id, host, path"""
