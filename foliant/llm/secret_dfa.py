"""Secret scans with one combined deterministic automaton.

Rules are regular expressions over bytes. For each rule the subset construction keeps *ordered* sets of
NFA states, one for each possible start, earliest first, so that the automaton finds leftmost-longest
matches that do not overlap. The rules' automata run side by side as one product, which is minimised and
laid out as transition arrays over byte classes. A text is read once, byte by byte; a transition can carry
the news that matches of some rules end before this byte. The start of a match is then found by running the
rule's reversed automaton back from its end.

Rules must be such that a match, once complete, stays complete for as long as it can be extended; the
compiler checks this and refuses others, as they would need to look back.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from foliant.llm.common import pick


@dataclass(frozen=True)
class Rule:
    """Matches of ``prefix`` then ``body``; kept if the body has ``least`` bytes or more.

    ``any_case`` lets the letters of the prefix stand for either case (ASCII).
    """

    kind: str
    prefix: str
    body: str
    least: int
    any_case: bool = False


# The patterns of the base kinds, in the order in which their spans are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 8, any_case=True),
    Rule("access", "", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", "", r"[0-9a-f]+", 32),
)
#: What the default rule set finds besides: vendor token shapes and the head of a private key.
MORE_RULES = (
    Rule("github", "", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("private_key", "", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
)
DEFAULT_RULES = BASE_RULES + MORE_RULES


# -- regular expression to NFA ------------------------------------------------------------------------


class Nfa:
    """Thompson's construction: states with empty moves and moves on sets of bytes."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def closure(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def step(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({m[1] for s in states if (m := self.moves[s]) and byte in m[0]})


class Parser:
    """A regular expression as a tree of ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most)."""

    def __init__(self, pattern: str, any_case: bool) -> None:
        self.p, self.i, self.any_case = pattern.encode(), 0, any_case

    def parse(self) -> tuple:
        tree = self.alternatives()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {chr(self.p[self.i])!r} at {self.i}")
        return tree

    def peek(self) -> str:
        return chr(self.p[self.i]) if self.i < len(self.p) else ""

    def alternatives(self) -> tuple:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, tree: tuple) -> tuple:
        bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(self.peek())
        if bounds:
            self.i += 1
        elif self.peek() == "{":
            end = self.p.index(b"}", self.i)
            low, _, high = self.p[self.i + 1 : end].decode().partition(",")
            bounds = (int(low), int(high) if high else None if b"," in self.p[self.i : end] else int(low))
            self.i = end + 1
        return ("rep", tree, *bounds) if bounds else tree

    def byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != 0x5C:
            return c
        c = self.p[self.i]
        self.i += 1
        if c == ord("x"):
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {ord("n"): 10, ord("t"): 9, ord("r"): 13}.get(c, c)

    def cased(self, members: set[int]) -> tuple:
        if self.any_case:
            members |= {x ^ 0x20 for x in members if chr(x).isalpha() and x < 128}
        return ("set", frozenset(members))

    def atom(self) -> tuple:
        if self.peek() == "(":
            self.i += 1
            tree = self.alternatives()
            self.i += 1
            return tree
        if self.peek() != "[":
            return self.cased({self.byte()})
        self.i += 1
        inverted = self.peek() == "^"
        self.i += inverted
        members: set[int] = set()
        while self.peek() != "]":
            low = self.byte()
            if self.peek() == "-" and self.p[self.i + 1] != ord("]"):
                self.i += 1
                members |= set(range(low, self.byte() + 1))
            else:
                members.add(low)
        self.i += 1
        return self.cased(set(range(256)) - members if inverted else members)


def _build(nfa: Nfa, tree: tuple, begin: int, reverse: bool) -> int:
    """Adds the tree's states after ``begin``; returns the end state."""
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        via = nfa.state()
        nfa.empty[begin].append(via)
        nfa.moves[via] = (tree[1], end)
        return end
    if kind == "cat":
        for part in reversed(tree[1]) if reverse else tree[1]:
            begin = _build(nfa, part, begin, reverse)
        return begin
    if kind == "alt":
        end = nfa.state()
        for part in tree[1]:
            first = nfa.state()
            nfa.empty[begin].append(first)
            nfa.empty[_build(nfa, part, first, reverse)].append(end)
        return end
    _, part, least, most = tree
    for _ in range(least):
        begin = _build(nfa, part, begin, reverse)
    if most is None:
        loop, end = nfa.state(), nfa.state()
        nfa.empty[begin].append(loop)
        nfa.empty[_build(nfa, part, loop, reverse)].append(loop)
        nfa.empty[loop].append(end)
        return end
    end = nfa.state()
    for _ in range(most - least):
        nfa.empty[begin].append(end)
        begin = _build(nfa, part, begin, reverse)
    nfa.empty[begin].append(end)
    return end


def _tree(rule: Rule, part: str = "both") -> tuple:
    trees = []
    if part in ("both", "prefix") and rule.prefix:
        trees.append(Parser(rule.prefix, rule.any_case).parse())
    if part in ("both", "body"):
        trees.append(Parser(rule.body, False).parse())
    return ("cat", trees)


class Anchored:
    """A plain deterministic automaton from a fixed position: the length of the longest match, or -1."""

    def __init__(self, tree: tuple, reverse: bool = False) -> None:
        nfa = Nfa()
        first = nfa.state()
        last = _build(nfa, tree, first, reverse)
        start = nfa.closure({first})
        number, todo, self.rows, self.final = {start: 0}, [start], [], []
        while todo:
            now = todo.pop(0)
            self.final.append(last in now)
            row = []
            for byte in range(256):
                to = nfa.step(now, byte)
                if to and to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to] if to else -1)
            self.rows.append(row)

    def longest(self, data: bytes) -> int:
        state, best = 0, 0 if self.final[0] else -1
        for i, byte in enumerate(data, 1):
            state = self.rows[state][byte]
            if state < 0:
                break
            if self.final[state]:
                best = i
        return best


# -- the combined search automaton --------------------------------------------------------------------

END = 256  # the symbol after the last byte


class Search:
    """One rule's leftmost-longest search as steps on (ordered start groups, whether the last has matched)."""

    def __init__(self, rule: Rule) -> None:
        self.nfa = Nfa()
        first = self.nfa.state()
        self.last = _build(self.nfa, _tree(rule), first, False)
        self.fresh = ((self.nfa.closure({first}),), False)
        if self.last in self.fresh[0][0]:
            raise ValueError(f"{rule.kind}: a rule must not match the empty string")

    def step(self, state: tuple, symbol: int) -> tuple[tuple, bool]:
        """The next state, and whether a match ended just before the symbol."""
        groups, matched = state
        seen: set[int] = set()
        kept = []
        for group in groups if symbol != END else ():
            to = self.nfa.step(group, symbol) - seen
            if to:
                kept.append(to)
                seen |= to
        done = next((i for i, g in enumerate(kept) if self.last in g), None)
        if done is not None:
            return (tuple(kept[: done + 1]), True), False
        if matched:
            if kept:
                raise ValueError("a complete match of this rule can become incomplete: it would need to look back")
            if symbol == END:
                return self.fresh, True
            return self.step(self.fresh, symbol)[0], True
        start = self.fresh[0][0] - seen
        return (tuple(kept) + ((start,) if start else ()), False), False


class Automaton:
    """The minimised product of the rules' searches, as transition arrays over byte classes."""

    def __init__(self, rules: tuple[Rule, ...] = DEFAULT_RULES) -> None:
        self.rules = rules
        searches = [Search(r) for r in rules]
        marks = {}
        for byte in range(256):
            marks.setdefault(tuple(byte in m[0] for s in searches for m in s.nfa.moves if m), []).append(byte)
        symbols = [group[0] for group in marks.values()] + [END]
        classes = bytearray(256)
        for k, group in enumerate(marks.values()):
            for byte in group:
                classes[byte] = k
        self.classes, self.end = bytes(classes), bytes([len(symbols) - 1])
        start = tuple(s.fresh for s in searches)
        number, todo, table = {start: 0}, [start], []
        known: list[dict] = [{} for _ in searches]
        while todo:
            now = todo.pop(0)
            row = []
            for symbol in symbols:
                to, news = [], 0
                for r, search in enumerate(searches):
                    key = (now[r], symbol)
                    if key not in known[r]:
                        known[r][key] = search.step(*key)
                    state, ended = known[r][key]
                    to.append(state)
                    news |= ended << r
                to = tuple(to)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append((number[to], news))
            table.append(row)
        self._minimise(table)
        self.back = [Anchored(_tree(r), reverse=True) for r in rules]
        self.prefix = [Anchored(_tree(r, "prefix")) if r.prefix else None for r in rules]

    def _minimise(self, table: list[list[tuple[int, int]]]) -> None:
        """Moore's refinement: states stay together while their news and their targets' blocks agree."""
        block = [0] * len(table)
        count = 0
        while True:
            keys: dict[tuple, int] = {}
            block = [keys.setdefault((block[s], *((block[to], news) for to, news in row)), len(keys)) for s, row in enumerate(table)]
            if len(keys) == count:
                break
            count = len(keys)
        # A target is numbered state + count * (index of its news); rows repeat for every index.
        self.news = sorted({news for row in table for _, news in row})
        index = {news: k for k, news in enumerate(self.news)}
        first = {b: s for s, b in reversed(list(enumerate(block)))}
        rows = [[block[to] + count * index[news] for to, news in table[first[b]]] for b in range(count)]
        self.count, self.start, self.rows = count, block[0], rows * len(self.news)

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(begin, rule index, end) in bytes, by begin and then rule; failing matches are dropped."""
        rows, count, state, out = self.rows, self.count, self.start, []
        free = [0] * len(self.rules)
        for i, c in enumerate(data.translate(self.classes) + self.end):
            state = rows[state][c]
            if state >= count:
                news = self.news[state // count]
                for r, rule in enumerate(self.rules):
                    if news >> r & 1:
                        begin = i - self.back[r].longest(data[free[r] : i][::-1])
                        free[r] = i
                        head = self.prefix[r].longest(data[begin:i]) if self.prefix[r] else 0
                        if i - begin - head >= rule.least:
                            out.append((begin, r, i))
        return sorted(out)


@functools.lru_cache(maxsize=8)
def automaton(rules: tuple[Rule, ...]) -> Automaton:
    return Automaton(rules)


_CONTINUATION = bytes(range(0x80, 0xC0))


def _in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if data.isascii():
        return spans
    at = {0: 0}
    byte = point = 0
    for x in sorted({x for b, _, e in spans for x in (b, e)}):
        point += len(data[byte:x].translate(None, _CONTINUATION))
        byte = x
        at[x] = point
    return [(at[b], r, at[e]) for b, r, e in spans]


SPAN = "array<struct<kind:string,begin:bigint,end:bigint>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))


def secret_spans(text: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """All secrets of a text as (kind, begin, end), by begin and then in the order of the rules.

    Offsets are code points, end exclusive. A null or empty text has none. Texts are read whole.
    """

    @arrow_udf(SPAN)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton(rules)
        for texts in batches:
            out = []
            for x in texts:
                data = x.as_py() or b""
                out.append([{"kind": rules[r].kind, "begin": b, "end": e} for b, r, e in _in_code_points(data, machine.spans(data))])
            yield pa.array(out, _SPAN_ARROW)

    return scan(text.cast("string").cast("binary"))


def redacted(text: Column, rules: tuple[Rule, ...] = DEFAULT_RULES, mark: str = "[{kind}]") -> Column:
    """The text with every secret replaced by ``mark``; overlapping secrets become one mark, of the first kind."""

    @arrow_udf("binary")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton(rules)
        for texts in batches:
            out = []
            for x in texts:
                data = x.as_py()
                if data and (spans := machine.spans(data)):
                    parts, at = [], 0
                    for begin, r, end in spans:
                        if begin >= at:
                            parts += [data[at:begin], mark.format(kind=rules[r].kind).encode()]
                        at = max(at, end)
                    data = b"".join([*parts, data[at:]])
                out.append(data)
            yield pa.array(out, pa.binary())

    return clean(text.cast("string").cast("binary")).cast("string")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """(doc_id, secrets) for every row, with the spans of ``secret_spans``; null ids and repeated rows stay."""
    return pick(docs, "doc_id", "text").select("doc_id", secret_spans(F.col("text"), rules).alias("secrets"))
