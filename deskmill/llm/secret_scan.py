"""Secret scan: all rules in one deterministic automaton over UTF-8 bytes.

The rules are parsed, joined to one nondeterministic automaton that may start at any byte, made deterministic by
subset construction and minimised; the result is a transition array over byte classes. One pass over the bytes of
a text gives the ends of matches of all rules. The start of a match is found by a second automaton of the reversed
rule, which reads back from the end over the match only.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.llm.names import free_name

# The rules, (kind, pattern, shortest match, shortest last group). Kinds come in the order of the report.
RULES = (
    ("assign", "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
               "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", 0),
    ("access", "AKIA[A-Z0-9]+", 20),
    ("hex", "[0-9a-f]{24,}", 24),
    ("github", "gh[oprsu]_[A-Za-z0-9]+", 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 24),
    ("google", "AIza[A-Za-z0-9_-]+", 39),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    ("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 40),
)
BASE = ("assign", "access", "hex")
VALUE = 6  # shortest value of an assignment
VALUE_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


# --- rules to syntax trees: ("set", bytes) | ("cat", parts) | ("alt", parts) | ("rep", part, least, most or None)

class _Parser:
    """Literals, classes, (?:...) and (...) groups, |, and the counts ? * + {m} {m,} {m,n}."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def choice(self):
        parts = [self.chain()]
        while self.peek() == "|":
            self.take()
            parts.append(self.chain())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def chain(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.counted())
        return ("cat", parts)

    def counted(self):
        one = self.single()
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            if sign == "{":
                end = self.text.index("}", self.at)
                least, comma, most = self.text[self.at:end].partition(",")
                self.at = end + 1
                one = ("rep", one, int(least), int(most or least) if most or not comma else None)
            else:
                one = ("rep", one, int(sign == "+"), 1 if sign == "?" else None)
        return one

    def single(self):
        sign = self.take()
        if sign == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            inner = self.choice()
            self.take()
            return inner
        if sign == "[":
            return ("set", self.members())
        if sign == "\\":
            sign = self.take()
        return ("set", frozenset(sign.encode()))

    def members(self) -> frozenset[int]:
        found: set[int] = set()
        while self.peek() != "]":
            low = high = ord(self.take())
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                high = ord(self.take())
            found.update(range(low, high + 1))
        self.take()
        return frozenset(found)


def _reversed(node):
    kind = node[0]
    if kind == "cat":
        return ("cat", [_reversed(x) for x in node[1]][::-1])
    if kind == "alt":
        return ("alt", [_reversed(x) for x in node[1]])
    return node if kind == "set" else ("rep", _reversed(node[1]), *node[2:])


@dataclass
class _Nfa:
    empty: list[list[int]] = field(default_factory=list)
    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """Thread a tree from ``start``; returns its last state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                self.empty[self.add(part, start)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(most - least):
            self.empty[start].append(end)
            start = self.add(part, start)
        self.empty[start].append(end)
        return end


@dataclass
class Automaton:
    """next state = moves[state + class of byte]; a state is its number times the number of classes.

    States from ``accepting`` on accept; ``marks`` says which rules (bits) by state number.
    """
    classes: bytes
    moves: array
    accepting: int
    marks: list[int]
    start: int
    width: int
    dead: int


def compile_rules(patterns: list[str], anywhere: bool, backwards: bool = False) -> Automaton:
    """Subset construction and minimisation (partition refinement) of all patterns together."""
    trees = [_Parser(p).choice() for p in patterns]
    trees = [_reversed(t) for t in trees] if backwards else trees
    nfa = _Nfa()
    root = nfa.state()
    finals: dict[int, int] = {}
    for i, tree in enumerate(trees):
        finals[nfa.add(tree, root)] = 1 << i
    # bytes that no rule tells apart share a class
    sets = {s for moves in nfa.moves for s, _ in moves}
    groups: dict[frozenset, int] = {}
    classes = bytes(groups.setdefault(frozenset(i for i, s in enumerate(sets) if b in s), len(groups)) for b in range(256))
    shown = [classes.index(c) for c in range(len(groups))]

    def closed(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    first = closed([root])
    number, order, table = {first: 0}, [first], []
    for states in order:
        row = []
        for byte in shown:
            goal = [to for s in states for chars, to in nfa.moves[s] if byte in chars]
            goal = closed(goal + [root] if anywhere else goal)
            if goal not in number:
                number[goal] = len(order)
                order.append(goal)
            row.append(number[goal])
        table.append(row)
    marks = [sum({finals[s] for s in states if s in finals}) for states in order]
    # refine: states stay together while they accept alike and go to the same blocks
    block = {m: i for i, m in enumerate(sorted(set(marks)))}
    block = [block[m] for m in marks]
    while True:
        names: dict[tuple, int] = {}
        finer = [names.setdefault((block[s], *(block[t] for t in row)), len(names)) for s, row in enumerate(table)]
        if len(names) == len(set(block)):
            break
        block = finer
    keep = {b: s for s, b in reversed(list(enumerate(block)))}
    place = {b: i for i, b in enumerate(sorted(keep, key=lambda b: (marks[keep[b]] != 0, b)))}
    width = len(shown)
    moves = array("l", [0]) * (len(place) * width)
    final = [0] * len(place)
    for b, s in keep.items():
        final[place[b]] = marks[s]
        for c, t in enumerate(table[s]):
            moves[place[b] * width + c] = place[block[t]] * width
    dead = next((i * width for i in range(len(place)) if not final[i]
                 and all(moves[i * width + c] == i * width for c in range(width))), -1)
    return Automaton(classes, moves, sum(not m for m in final) * width, final, place[block[0]] * width, width, dead)


class Scanner:
    """The combined automaton, and one reversed automaton per rule for the starts."""

    def __init__(self, rules=RULES):
        self.rules = rules
        self.ahead = compile_rules([r[1] for r in rules], anywhere=True)
        self.back = [compile_rules([r[1]], anywhere=False, backwards=True) for r in rules]

    def ends(self, data: bytes) -> list[list[int]]:
        """Per rule the last byte (exclusive) of every unbroken row of accepting bytes."""
        auto = self.ahead
        found: list[list[int]] = [[] for _ in self.rules]
        moves, accepting, width = auto.moves, auto.accepting, auto.width
        state = auto.start
        rest = iter(data.translate(auto.classes))
        left = rest.__length_hint__
        size = len(data)
        for c in rest:
            state = moves[state + c]
            if state >= accepting:
                end, mark, rule = size - left(), auto.marks[state // width], 0
                while mark:
                    if mark & 1:
                        row = found[rule]
                        if row and row[-1] == end - 1:
                            row[-1] = end
                        else:
                            row.append(end)
                    mark >>= 1
                    rule += 1
        return found

    def start(self, rule: int, data: bytes, end: int, bound: int) -> int | None:
        """The leftmost start, not before ``bound``, of a match that stops at ``end``."""
        auto, best = self.back[rule], None
        state = auto.start
        for i in range(end - 1, bound - 1, -1):
            state = auto.moves[state + auto.classes[data[i]]]
            if state >= auto.accepting:
                best = i
            elif state == auto.dead:
                break
        return best

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then in the order of the rules."""
        data = (text or "").encode("utf-8", "surrogatepass")
        found = []
        for rule, ends in enumerate(self.ends(data)):
            kind, _, shortest = self.rules[rule]
            bound = 0
            for end in ends:
                start = self.start(rule, data, end, bound)
                if start is None:
                    continue
                bound = end
                if end - start >= shortest and (kind != "assign" or self._value(data, start, end) >= VALUE):
                    found.append((start, rule, end))
        if not found:
            return []
        found.sort()
        place, at, seen = {}, 0, 0
        for x in sorted({p for s, _, e in found for p in (s, e)}):
            seen += len(data[at:x].decode("utf-8", "surrogatepass"))
            at, place[x] = x, seen
        return [(self.rules[r][0], place[s], place[e]) for s, r, e in found]

    @staticmethod
    def _value(data: bytes, start: int, end: int) -> int:
        """Length of the value: it follows the first separator, blanks and one quote."""
        at = min(i for i in (data.find(b":", start, end), data.find(b"=", start, end)) if i >= 0) + 1
        while data[at] == 0x20:
            at += 1
        return end - at - (data[at] not in VALUE_BYTES)


def report(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str | None, spans) -> str | None:
    """The text with every span replaced by [kind]; of overlapping spans one mark stays."""
    if not spans:
        return text
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def find_secrets(docs: DataFrame, text_col: str = "text", clean_col: str | None = None, rules=RULES) -> DataFrame:
    """Adds ``secrets`` (array of kind, start, end in code points) and, if asked, the redacted text.

    No shuffle; every text is read whole. A null text has no secrets and stays null; an empty table stays empty.
    All columns are kept; a column named like an added one is replaced. Repeated rows are scanned each.
    """
    scanner = Scanner(rules)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType())])
    added = [("secrets", T.ArrayType(span))] + ([(clean_col, T.StringType())] if clean_col else [])
    kept = [c for c in docs.columns if c not in [n for n, _ in added] or c == text_col]
    work_col = free_name("_text", [*docs.columns, *[n for n, _ in added]])
    source = docs.select(*kept, F.col(text_col).cast("string").alias(work_col))
    schema = T.StructType([f for f in source.schema if f.name not in [*(n for n, _ in added), work_col]]
                          + [T.StructField(n, t) for n, t in added])
    stay = [f.name for f in schema if f.name not in [n for n, _ in added]]

    def run(batches):
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = batch.column(work_col).to_pylist()
            spans = [scanner.spans(x) for x in texts]
            columns = [batch.column(n) for n in stay]
            columns.append(pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], kinds))
            if clean_col:
                columns.append(pa.array([redacted(t, x) for t, x in zip(texts, spans)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*stay, *(n for n, _ in added)])

    return source.mapInArrow(run, schema)


def span_text(spans, kinds: tuple[str, ...] | None = None):
    """Column: spans (of some kinds) as kind:start:end, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
