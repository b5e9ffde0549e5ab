"""Secret scans by one combined deterministic automaton.

The rules' regular expressions become one nondeterministic automaton, read backwards so that it says where
matches begin. Subset construction and partition refinement turn it into the smallest deterministic one,
whose transition arrays read each byte of a text once for all rules together. From the few places where
something begins, the rule's own (also minimal) forward automaton finds the longest end, which gives the
leftmost longest matches that don't overlap, rule by rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, table


class Rule(NamedTuple):
    """kind, a regular expression over bytes, the fewest characters of the match, or of its last group.

    The expression may use literals, sets, groups, |, ?, *, +, {n,} and escapes; (?i:...) takes ASCII letters in either case.
    """

    kind: str
    pattern: str
    least: int
    group: str = ""


#: The three rules that the query's contract names, in its order, then common token formats.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8, "A-Za-z0-9+/_.=-"),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),  # the runs of [0-9a-f]+ that are long enough: the automaton counts
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN[A-Z ]+PRIVATE KEY-----", 0),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
)
RULES = BASE_RULES + MORE_RULES


class _Parser:
    """Expression to a tree of ("set", frozenset of bytes), ("cat", parts), ("or", parts), ("many", part, least, most)."""

    def __init__(self, pattern: str):
        self.s, self.i = pattern, 0

    def either(self, fold: bool):
        parts = [self.sequence(fold)]
        while self.s[self.i : self.i + 1] == "|":
            self.i += 1
            parts.append(self.sequence(fold))
        return ("or", parts)

    def sequence(self, fold: bool):
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            part = self.atom(fold)
            mark = self.s[self.i : self.i + 1]
            if mark and mark in "?*+":
                self.i += 1
                part = ("many", part, 1 if mark == "+" else 0, 1 if mark == "?" else None)
            elif mark == "{":
                end = self.s.index(",}", self.i)
                part = ("cat", [part] * (int(self.s[self.i + 1 : end]) - 1) + [("many", part, 1, None)])
                self.i = end + 2
            parts.append(part)
        return ("cat", parts)

    def atom(self, fold: bool):
        c = self.s[self.i]
        if c == "(":
            if self.s.startswith("(?i:", self.i):
                self.i, fold = self.i + 4, True
            else:
                self.i += 3 if self.s.startswith("(?:", self.i) else 1
            inner = self.either(fold)
            self.i += 1
            return inner
        if c == "[":
            self.i += 1
            found: set[int] = set()
            while self.s[self.i] != "]":
                low = self.byte()
                if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                    self.i += 1
                    found.update(range(low, self.byte() + 1))
                else:
                    found.add(low)
            self.i += 1
        else:
            found = {self.byte()}
        if fold:
            found |= {b ^ 0x20 for b in found if chr(b).isalpha()}
        return ("set", frozenset(found))

    def byte(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "\\":
            c = self.s[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)


def _backwards(tree):
    if tree[0] == "cat":
        return ("cat", [_backwards(t) for t in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [_backwards(t) for t in tree[1]])
    return tree if tree[0] == "set" else ("many", _backwards(tree[1]), *tree[2:])


class _Nfa:
    def __init__(self):
        self.free: list[set[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append(set())
        self.step.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Builds the tree from start and returns its end."""
        if tree[0] == "set":
            here, end = self.state(), self.state()
            self.free[start].add(here)
            self.step[here] = (tree[1], end)
            return end
        if tree[0] == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if tree[0] == "or":
            for part in tree[1]:
                self.free[self.add(part, start)].add(end)
            return end
        _, part, least, most = tree
        inner = self.state()
        self.free[start].add(inner)
        done = self.add(part, inner)
        self.free[done].add(end)
        if not least:
            self.free[start].add(end)
        if most is None:
            self.free[done].add(inner)
        return end

    def closed(self, states) -> frozenset[int]:
        found, stack = set(states), list(states)
        while stack:
            for t in self.free[stack.pop()] - found:
                found.add(t)
                stack.append(t)
        return frozenset(found)


def _determined(nfa: _Nfa, start: int, ends: dict[int, int], restart: bool) -> tuple[list[list[int]], list[int]]:
    """Subset construction: rows of 256 targets, and the accepted rules of each state as bits. State 0 starts."""
    first = nfa.closed({start})
    known, todo, rows, accept = {first: 0}, [first], [], []
    while todo:
        states = todo.pop(0)
        to: list[set[int]] = [set() for _ in range(256)]
        for s in states:
            if nfa.step[s]:
                for b in nfa.step[s][0]:
                    to[b].add(nfa.step[s][1])
        row, seen = [], {}
        for b in range(256):
            key = frozenset(to[b])
            if key not in seen:
                target = nfa.closed(key | {start} if restart else key)
                if target not in known:
                    known[target] = len(known)
                    todo.append(target)
                seen[key] = known[target]
            row.append(seen[key])
        rows.append(row)
        accept.append(sum(1 << ends[s] for s in states if s in ends))
    return rows, accept


def _minimal(rows: list[list[int]], accept: list[int]) -> tuple[list[list[int]], list[int]]:
    """Partition refinement until states of a class agree on the classes they go to."""
    numbered: dict = {}
    kind = [numbered.setdefault(a, len(numbered)) for a in accept]
    while True:
        numbered = {}
        new = [numbered.setdefault((kind[i], *(kind[t] for t in row)), len(numbered)) for i, row in enumerate(rows)]
        if len(numbered) == len(set(kind)):
            break
        kind = new
    # classes are numbered as met, so the start state's class is 0
    first = {}
    for i, c in enumerate(new):
        first.setdefault(c, i)
    return [[new[t] for t in rows[first[c]]] for c in range(len(first))], [accept[first[c]] for c in range(len(first))]


class Automaton:
    """The compiled rules: `starts` reads a text backwards once for all of them, `forward` one match of one rule."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        nfa, ends = _Nfa(), {}
        top = nfa.state()
        trees = [_Parser(r.pattern).either(False) for r in rules]
        for k, tree in enumerate(trees):
            ends[nfa.add(_backwards(tree), top)] = k
        self.rows, self.accept = _minimal(*_determined(nfa, top, ends, restart=True))
        self.forward = []
        for tree in trees:
            nfa = _Nfa()
            top = nfa.state()
            rows, accept = _minimal(*_determined(nfa, top, {nfa.add(tree, top): 0}, restart=False))
            dead = [not a and set(row) == {i} for i, (row, a) in enumerate(zip(rows, accept, strict=True))]
            self.forward.append((rows, accept, dead))
        # Rows point at rows: one index a byte. The last entry holds the accepted rules.
        self.linked = [[None] * 256 + [a] for a in self.accept]
        for row, targets in zip(self.linked, self.rows, strict=True):
            row[:256] = [self.linked[t] for t in targets]

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(position, rules as bits) where a match begins, from the end of the text to its start."""
        row, found, at = self.linked[0], [], len(data)
        for b in reversed(data):
            row = row[b]
            at -= 1
            if row[256]:
                found.append((at, row[256]))
        return found

    def longest(self, k: int, data: bytes, start: int) -> int:
        rows, accept, dead = self.forward[k]
        state, end = 0, start
        for i in range(start, len(data)):
            state = rows[state][data[i]]
            if accept[state]:
                end = i + 1
            elif dead[state]:
                break
        return end

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start, then rule: leftmost longest, not overlapping within a rule."""
        out, last = [], [0] * len(self.rules)
        for start, bits in reversed(self.starts(data)):
            k = 0
            while bits:
                if bits & 1 and start >= last[k]:
                    end = last[k] = self.longest(k, data, start)
                    if self._kept(k, data[start:end]):
                        out.append((start, k, end))
                bits >>= 1
                k += 1
        return out

    def _kept(self, k: int, found: bytes) -> bool:
        rule = self.rules[k]
        if rule.group:
            tail = len(found) - len(found.rstrip(_members(rule.group)))
            # the value begins after the sign that divides it from the name, which the set may hold as well
            name = min((i for i in (found.find(b":"), found.find(b"=")) if i >= 0), default=-1)
            value = found[name + 1 :].lstrip(b" ")
            tail = min(tail, len(value) - (value[:1] in (b'"', b"'")))
            return tail >= rule.least
        return len(found) >= rule.least


@lru_cache
def _members(group: str) -> bytes:
    return bytes(_Parser(f"[{group}]").atom(False)[1])


@lru_cache
def automaton(rules: tuple[Rule, ...] = RULES) -> Automaton:
    return Automaton(rules)


def find(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points of every secret in a text; none in a null."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = automaton(rules).matches(data)
    if found and len(data) != len(text):
        marks = sorted({p for s, _, e in found for p in (s, e)})
        place, chars, before = {}, 0, 0
        for p in marks:
            chars += len(data[before:p].decode("utf-8", "surrogatepass"))
            place[p], before = chars, p
        found = [(place[s], k, place[e]) for s, k, e in found]
    return found


def _spans(found, rules) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in found)


def redacted(text: str | None, rules: tuple[Rule, ...] = RULES) -> str | None:
    """The text with every secret replaced by <secret:kind>; overlapping ones become one, named by the first."""
    out, at = [], 0
    for s, k, e in find(text, rules):
        if s >= at:
            out.append(f"{text[at:s]}<secret:{rules[k].kind}>")
        at = max(at, e)
    return text if not out else "".join([*out, text[at:]])


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """All secrets of every text: counts of the base rules, a digest of their spans, and all spans.

    Positions are code points, ends exclusive. A null or empty text has none; null ids and repeated rows
    stay; other columns are ignored; an empty table gives no rows. No shuffle: each text is read once.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = range(len(BASE_RULES))
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = find(text)
                own = [x for x in found if x[1] in base]
                out.append((*(sum(x[1] == k for x in own) for k in base), hashlib.sha256(_spans(own, RULES).encode()).hexdigest(), _spans(found, RULES)))
            yield pd.concat([batch["doc_id"], pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")][1:])], axis=1)

    return by_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), rows, FOUND)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the secrets of its texts replaced (redacted()); all columns and rows stay, nulls stay null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redacted, na_action="ignore")

    return docs.withColumn(text, clean(F.col(text)))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
