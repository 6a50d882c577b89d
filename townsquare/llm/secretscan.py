"""Secret scans by one combined automaton over bytes.

All rules are compiled together: each regular expression becomes a
nondeterministic automaton, the union of all of them, started anew at every
byte, is made deterministic by subset construction and minimised, and the
result is one array of transitions. A text is then read once, byte by byte, for
all rules at once. Where a rule accepts, an automaton of the reversed rule
reads back to the start of the match, and the rule's own one reads on to its
end; both only ever touch bytes of the match.

Expressions may use literals, classes, groups, ``|``, ``?``, ``*``, ``+`` and
``{m}``, ``{m,}``, ``{m,n}``. Matches are leftmost-longest, without overlap
within a rule. A rule must not be able to match wholly inside another match of
its own before that one's first accepting byte; no rule here can.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townsquare.llm.common import packed, small_batches, unpacked, utf8


class Rule(NamedTuple):
    """A kind of secret: a head, then a run of the class ``value`` of at least ``least`` bytes.

    The match is the longest one; if its run is shorter, it is dropped, though
    what it covers stays used. The combined automaton only looks for the head
    and the first byte of the run. That keeps counters and runs out of it: only
    a rule without a telling head needs a counter, as ``hex`` does.
    """

    kind: str
    pattern: str
    value: str = ""
    least: int = 0
    any_case: bool = False  #: letters of ``pattern`` match in either case


#: The fixed kinds. The order of the rules is that of the results.
BASE_RULES = (
    Rule(
        "assign",
        "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?",
        "[A-Za-z0-9+/_.=-]",
        6,
        any_case=True,
    ),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Further kinds, by the published forms of common credentials.
MORE_RULES = (
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("stripe", "[sr]k_live_", "[A-Za-z0-9]", 16),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.", "[A-Za-z0-9_-]", 8),
    Rule("bearer", "bearer\\x20+", "[A-Za-z0-9+/_.=-]", 16, any_case=True),
)
RULES = BASE_RULES + MORE_RULES

# Syntax trees: ("set", bytes), ("cat", [..]), ("alt", [..]), ("rep", tree, least, most or None)


def parse(pattern: str, any_case: bool) -> tuple:
    """The syntax tree of an expression over bytes."""
    data, at = pattern.encode(), 0

    def escaped() -> int:
        nonlocal at
        code = data[at]
        at += 1
        if code == ord("x"):
            at += 2
            return int(data[at - 2 : at], 16)
        return {ord("n"): 10, ord("t"): 9, ord("r"): 13}.get(code, code)

    def bracket() -> tuple:
        nonlocal at
        chosen, negated = set(), data[at] == ord("^")
        at += negated
        while data[at] != ord("]"):
            low = data[at]
            at += 1
            if low == ord("\\"):
                low = escaped()
            high = low
            if data[at] == ord("-") and data[at + 1] != ord("]"):
                high = data[at + 1]
                at += 2
            chosen.update(range(low, high + 1))
        at += 1
        return ("set", frozenset(range(256)) - chosen if negated else frozenset(chosen))

    def atom() -> tuple:
        nonlocal at
        code = data[at]
        at += 1
        if code == ord("("):
            tree = choice()
            at += 1
            return tree
        if code == ord("["):
            return bracket()
        if code == ord("\\"):
            code = escaped()
        both = {code, ord(chr(code).swapcase())} if any_case and chr(code).isalpha() and code < 128 else {code}
        return ("set", frozenset(both))

    def repeated() -> tuple:
        nonlocal at
        tree = atom()
        while at < len(data) and data[at : at + 1] in b"?*+{":
            sign = data[at]
            at += 1
            if sign == ord("{"):
                end = data.index(b"}", at)
                low, comma, high = data[at:end].partition(b",")
                at = end + 1
                tree = ("rep", tree, int(low), (int(high) if high else None) if comma else int(low))
            else:
                tree = ("rep", tree, sign == ord("+"), 1 if sign == ord("?") else None)
        return tree

    def sequence() -> tuple:
        parts = []
        while at < len(data) and data[at : at + 1] not in b"|)":
            parts.append(repeated())
        return ("cat", parts)

    def choice() -> tuple:
        nonlocal at
        options = [sequence()]
        while at < len(data) and data[at] == ord("|"):
            at += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    return choice()


def reverse(tree: tuple) -> tuple:
    """The tree of the same texts read backwards."""
    if tree[0] == "cat":
        return ("cat", [reverse(t) for t in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [reverse(t) for t in tree[1]])
    if tree[0] == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    return tree


class _Nfa:
    """Thompson's construction: empty moves and byte moves between numbered states."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Build ``tree`` from ``start`` on; the state where it ends."""
        if tree[0] == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if tree[0] == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if tree[0] == "alt":
            for part in tree[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(part, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            start = loop
        else:
            for _ in range(most - least):
                self.empty[start].append(end)
                start = self.add(part, start)
        self.empty[start].append(end)
        return end

    def closed(self, states: Iterable[int]) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for other in self.empty[todo.pop()]:
                if other not in found:
                    found.add(other)
                    todo.append(other)
        return frozenset(found)


class Automaton(NamedTuple):
    """``table[state + classes[byte]]`` is the next state; states are offsets into the table.

    States from ``accepting`` on accept; ``accepts`` gives their rules as bits.
    State ``start`` is the first one. ``dead`` is the state without a way out, or -1.
    """

    classes: bytes
    width: int
    table: list[int]
    start: int
    accepting: int
    accepts: dict[int, int]
    dead: int


def build(trees: list[tuple], anywhere: bool) -> Automaton:
    """Subset construction and minimisation; rule i accepts with bit i.

    ``anywhere`` starts every rule anew at each byte.
    """
    nfa, finals = _Nfa(), {}
    root = nfa.state()
    for i, tree in enumerate(trees):
        finals[nfa.add(tree, root)] = 1 << i
    first = nfa.closed([root])

    # Bytes that no rule tells apart are one class.
    kinds: dict[frozenset, int] = {}
    sets = sorted({chosen for moves in nfa.moves for chosen, _ in moves}, key=sorted)
    classes = bytearray(256)
    for byte in range(256):
        classes[byte] = kinds.setdefault(frozenset(i for i, s in enumerate(sets) if byte in s), len(kinds))
    width, sample = len(kinds), [classes.index(k) for k in range(len(kinds))]

    numbers, order, rows = {first: 0}, [first], []
    for subset in order:
        targets: list[set] = [set() for _ in range(width)]
        for state in subset:
            for chosen, to in nfa.moves[state]:
                for k, byte in enumerate(sample):
                    if byte in chosen:
                        targets[k].add(to)
        row = []
        for reached in targets:
            after = nfa.closed(reached | {root} if anywhere else reached)
            if after not in numbers:
                numbers[after] = len(order)
                order.append(after)
            row.append(numbers[after])
        rows.append(row)
    bits = [sum(finals.get(s, 0) for s in subset) for subset in order]

    # Moore's refinement: states are split until equal ones agree on all moves.
    block = list(bits)
    count = len(set(block))
    while True:
        keys: dict[tuple, int] = {}
        block = [keys.setdefault((block[s], *[block[t] for t in rows[s]]), len(keys)) for s in range(len(rows))]
        if len(keys) == count:
            break
        count = len(keys)

    one = {}
    for s, b in enumerate(block):
        one.setdefault(b, s)
    ranked = sorted(one, key=lambda b: (bits[one[b]] > 0, b))
    place = {b: i * width for i, b in enumerate(ranked)}
    table = [place[block[t]] for b in ranked for t in rows[one[b]]]
    accepts = {place[b]: bits[one[b]] for b in ranked if bits[one[b]]}
    dead = next((place[b] for b in ranked if not bits[one[b]] and all(block[t] == b for t in rows[one[b]])), -1)
    return Automaton(bytes(classes), width, table, place[block[0]], min(accepts, default=len(table)), accepts, dead)


def longest(automaton: Automaton, data: bytes | Iterable[int]) -> int:
    """Bytes of the longest accepted beginning, or -1."""
    state, found = automaton.start, -1
    classes, table = automaton.classes, automaton.table
    for i, byte in enumerate(data, 1):
        state = table[state + classes[byte]]
        if state >= automaton.accepting:
            found = i
        elif state == automaton.dead:
            break
    return found


class Scanner:
    """All rules as one automaton, and each one's own and its reverse for the ends of a match."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        heads = [parse(r.pattern, r.any_case) for r in rules]
        runs = [parse(r.value, False) for r in rules]  # of nothing, if there is no value
        first = [("cat", [h, v]) for h, v in zip(heads, runs, strict=True)]
        whole = [("cat", [h, ("rep", v, 1, None)] if r.value else [h]) for r, h, v in zip(rules, heads, runs, strict=True)]
        self.rules = rules
        self.combined = build(first, anywhere=True)
        self.ahead = [build([t], anywhere=False) for t in whole]
        self.back = [build([reverse(t)], anywhere=False) for t in whole]
        self.heads = [build([h], anywhere=False) for h in heads]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """Matches as (start, rule, end) in bytes, by start and rule."""
        combined = self.combined
        table, accepting, state = combined.table, combined.accepting, combined.start
        hits = []
        for i, kind in enumerate(data.translate(combined.classes), 1):
            state = table[state + kind]
            if state >= accepting:
                hits.append((i, state))
        done, found = [0] * len(self.rules), []
        for i, state in hits:
            rules, rule = combined.accepts[state], 0
            while rules:
                if rules & 1 and i > done[rule]:
                    size = longest(self.back[rule], _backwards(data, i, done[rule]))
                    if size > 0:
                        start = i - size
                        end = start + longest(self.ahead[rule], _forwards(data, start))
                        done[rule] = end
                        if self._long_enough(rule, data, start, end):
                            found.append((start, rule, end))
                rules >>= 1
                rule += 1
        return sorted(found)

    def _long_enough(self, rule: int, data: bytes, start: int, end: int) -> bool:
        """Whether what follows the head of the match is as long as the rule asks."""
        least = self.rules[rule].least
        return not least or end - start - longest(self.heads[rule], data[start:end]) >= least


def _backwards(data: bytes, end: int, least: int) -> Iterator[int]:
    return (data[k] for k in range(end - 1, least - 1, -1))


def _forwards(data: bytes, start: int) -> Iterator[int]:
    return (data[k] for k in range(start, len(data)))


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """The compiled rules, once per Python process."""
    return Scanner(rules)


def find(text: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """Matches in a UTF-8 text as (kind, start, end) in code points, end exclusive."""
    found = scanner(rules).spans(text)
    if not found or text.isascii():
        return [(rules[rule].kind, start, end) for start, rule, end in found]
    points, at, seen = {}, 0, 0
    for place in sorted({p for start, _, end in found for p in (start, end)}):
        seen += len(text[at:place].decode("utf-8", "replace"))
        at, points[place] = place, seen
    return [(rules[rule].kind, points[start], points[end]) for start, rule, end in found]


def scan_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secrets``: an array of (kind, start, end), by start, then in the order of the rules.

    Null and empty texts have none; texts of any length are scanned whole, in one
    pass. Rows are independent, so equal rows get equal results and nothing is
    shuffled; no rows, no result. A column ``secrets`` is replaced.
    """

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(
                [[{"kind": k, "start": s, "end": e} for k, s, e in find(bytes(t), rules)] for t in texts], dtype=object
            )

    small_batches(docs.sparkSession)
    # Without a non-deterministic mark the optimizer would run the scan once per use.
    scanned = F.pandas_udf(scan, "array<struct<kind:string,start:bigint,end:bigint>>").asNondeterministic()
    rows = packed(docs).withColumn("found", scanned(utf8(F.col(f"row.`{text}`"))))
    return unpacked(rows, secrets=F.col("found"))


def secrets_digest(docs: DataFrame) -> DataFrame:
    """Counts of the fixed kinds, a checksum of their spans, and all spans."""
    found = scan_secrets(docs.select("doc_id", "text"))

    def spans(chosen: Column) -> Column:
        return F.array_join(
            F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")

    own = F.filter("secrets", lambda s: s["kind"].isin([rule.kind for rule in BASE_RULES]))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(spans(own), 256).alias("base_sha256"), spans(F.col("secrets")).alias("spans"),
    )
