"""Token counts of a byte-level BPE tokenizer by finite-state transducers.

Two deterministic machines are compiled from the tokenizer's file:

* **Pre-tokens.** Twelve states over twelve classes of characters; a transition says whether a pre-token starts at the character
  it reads, or started at the one before (white space and contractions are decided one character late). All texts of a batch
  lie in one sequence that is cut into chunks. Each chunk is run from every state at once, which gives its state map; the maps
  compose by a parallel prefix scan, and a second run from the states found marks the starts. A very long text is as many
  chunks as it needs.
* **Tokens.** After every byte of a pre-token exactly one token ends the encoding so far: the one that starts where an encoding
  ends that it may follow. A state is the set of vocabulary prefixes that are open, each with the token before it and how many
  tokens lie since; a transition reads a byte and says by how much the number of tokens changes. States are made by subset
  construction when they are first met, so only what texts need of the machine exists; all pre-tokens of a batch step through
  the transition table together.

Which token may follow which is read off the merge list. Nothing is shuffled, no text is cut.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.llm.bpe import TO_BYTE

CHUNK = 256  # characters run one after the other
MOST_STATES = 65_000  # of the token machine, 1.3 KB each; it starts anew beyond that
MOST_BELOW = 64  # tokens below a prefix that are looked through to tell its states apart
SLICE = 8 << 20  # characters worked on at a time, unless one text is longer

# Classes of characters: letters that end or begin a contraction stand apart
LETTER, NUMBER, SPACE, WHITE, MARK, OTHER, SHORT, R, V, L, E, END = range(12)
LETTERS = (LETTER, SHORT, R, V, L, E)
# States: a fresh start, inside letters, numbers or others; one or more white-space characters, the last a space or not; an
# apostrophe at the start of a pre-token, and the same with r, v or l after it
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, SPACE1, WHITE1, SPACES, WHITES, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(12)
BEGIN = {NUMBER: IN_NUMBERS, SPACE: SPACE1, WHITE: WHITE1, MARK: QUOTE, OTHER: IN_OTHERS, END: FRESH,
         **dict.fromkeys(LETTERS, IN_LETTERS)}
HERE, BEFORE = 1, 2  # a pre-token starts at the character read, at the one before it


def _pretoken_step(state: int, c: int) -> tuple[int, int]:
    """Next state and starts of pre-tokens. END closes a text; it is never inside a pre-token."""
    new = BEGIN[c], HERE
    joined = {IN_LETTERS: LETTERS, IN_NUMBERS: (NUMBER,), IN_OTHERS: (OTHER, MARK)}
    if state in joined:
        return (state, 0) if c in joined[state] else new
    if state in (SPACE1, WHITE1, SPACES, WHITES):
        if c in (SPACE, WHITE):
            return (SPACES if c == SPACE else WHITES), 0
        if c == END:
            return new
        late = BEFORE if state in (SPACES, WHITES) else 0  # the last white-space character leaves its run
        if state in (SPACE1, SPACES):  # and a space joins what follows
            return (IN_OTHERS if c == MARK else BEGIN[c]), late
        return BEGIN[c], late | HERE
    if state == QUOTE:
        if c == SHORT:
            return FRESH, 0
        if c in (R, V, L):
            return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], 0
        return (IN_OTHERS, 0) if c in (OTHER, MARK) else new
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if c == (L if state == QUOTE_L else E):
            return FRESH, 0
        return (IN_LETTERS, BEFORE) if c in LETTERS else (BEGIN[c], BEFORE | HERE)
    return new


STEPS = np.array([[_pretoken_step(s, c) for c in range(12)] for s in range(12)], np.uint8)
NEXT, STARTS = STEPS[:, :, 0].copy(), STEPS[:, :, 1].copy()


def character_classes() -> tuple[np.ndarray, np.ndarray]:
    """First code points and classes of ranges of equal class, as the tokenizers library's own pattern engine sees them."""
    from tokenizers import Regex, normalizers

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    kinds = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        marked = normalizers.Replace(Regex(pattern), "\x01").normalize_str(text)
        hits = points[np.frombuffer(marked.encode("utf-32-le"), "<u4") == 1]
        kinds[hits[hits != 1]] = kind
    for characters, kind in ((" ", SPACE), ("'", MARK), ("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E)):
        kinds[[ord(c) for c in characters]] = kind
    first = np.flatnonzero(np.diff(kinds, prepend=255))
    return first, kinds[first]


def pretoken_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a pre-token starts at each character; ``classes`` ends with END."""
    n = len(classes)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, END, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(rows, chunk).T)
    maps = np.tile(np.arange(12, dtype=np.uint8), (rows, 1))  # state before a chunk -> state after it
    for column in columns:
        maps = NEXT[maps, column[:, None]]
    step = 1
    while step < rows:  # parallel prefix scan: every chunk's map after those before it
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], 1)
        step *= 2
    state = np.concatenate([[FRESH], maps[:-1, FRESH]]).astype(np.uint8)
    said = np.empty((chunk, rows), np.uint8)
    for k, column in enumerate(columns):
        said[k] = STARTS[state, column]
        state = NEXT[state, column]
    said = said.T.reshape(-1)[:n]
    starts = (said & HERE).astype(bool)
    starts[:-1] |= (said[1:] & BEFORE).astype(bool)
    return starts


class TokenMachine:
    """Reads the bytes of a pre-token and counts its tokens."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        numbers = {t: i for i, t in enumerate(vocabulary)}
        self.parts = [(-1, -1)] * len(numbers)
        self.rank = [-1] * len(numbers)
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            whole, pair = numbers[a + b], (numbers[a], numbers[b])
            self.merged.setdefault(pair, rank)
            if self.rank[whole] < 0:
                self.rank[whole], self.parts[whole] = rank, pair
        reached = [True] * len(numbers)
        tree: dict[int, int] = {}
        ends, inner = [-1], [False]
        for text, token in sorted(numbers.items(), key=lambda x: self.rank[x[1]]):
            a, b = self.parts[token]
            if a < 0 and len(text) > 1:
                reached[token] = False  # no merge makes it
            elif a >= 0:
                reached[token] = reached[a] and reached[b] and self._apart(a, b, self.rank[token])
            if not reached[token]:
                continue
            node = 0
            for c in text:
                key = node << 8 | TO_BYTE[c]
                if key not in tree:
                    tree[key] = len(ends)
                    inner[node] = True
                    ends.append(-1)
                    inner.append(False)
                node = tree[key]
            ends[node] = token
        self.tree, self.ends, self.inner = tree, ends, inner
        self.below = self._tokens_below()
        self._clear()

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether a and b, side by side, both come about before merge ``limit`` and no merge joins over their border.

        Merges at the border are undone from the latest on. What then lies at the border was there at that time; had it been
        merged across, a or b would not have come about. Of equal merges the left one is first.
        """
        merged, rank, parts = self.merged, self.rank, self.parts
        while True:
            joint = merged.get((a, b))
            if joint is not None and joint < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], parts[a][1]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, parts[b][0]
            else:
                return True

    def _tokens_below(self) -> list[tuple[int, ...] | None]:
        """The tokens that go on from each node, None where they are more than MOST_BELOW."""
        below: list[tuple[int, ...] | None] = [()] * len(self.ends)
        for key, node in reversed(self.tree.items()):  # children come after their parents
            parent = key >> 8
            own = (self.ends[node],) if self.ends[node] >= 0 else ()
            if below[parent] is not None:
                both = None if below[node] is None else below[parent] + own + below[node]
                below[parent] = both if both is not None and len(both) <= MOST_BELOW else None
        return below

    def _open(self, node: int, before: int) -> int | None:
        """A token that stands for ``before`` in an open item, or None if no token below the node may follow it.

        Tokens that the same tokens below the node may follow are one, which keeps the machine small.
        """
        key = node << 20 | before
        found = self.opened.get(key, -1)
        if found == -1:
            below = self.below[node]
            if below is None:
                found = before
            else:
                after = (node, *[t for t in below if self.may_follow(before, t)])
                found = self.standing.setdefault(after, before) if len(after) > 1 else None
            self.opened[key] = found
        return found

    def may_follow(self, a: int, b: int) -> bool:
        return self._apart(a, b, 1 << 60)

    def _clear(self):
        self.states: dict[tuple, int] = {}
        self.items: list[tuple] = []
        self.table = np.full((1024, 256), -1, np.int32)
        self.change = np.zeros((1024, 256), np.int8)
        self.start = self._state(((0, -1, 0),))
        self.opened: dict[int, int | None] = {}
        self.standing: dict[tuple, int] = {}

    def _state(self, items: tuple) -> int:
        state = self.states.get(items)
        if state is None:
            state = self.states[items] = len(self.items)
            self.items.append(items)
            if state == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.change = np.concatenate([self.change, np.zeros_like(self.change)])
        return state

    def compile(self, state: int, byte: int):
        """Fill one transition. An item is (open vocabulary prefix, token before it, tokens up to there less tokens up to now)."""
        tree, ends, inner = self.tree, self.ends, self.inner
        kept, last, change = [], -1, 0
        for node, before, tokens in self.items[state]:
            node = tree.get(node << 8 | byte, -1)
            if node < 0:
                continue
            token = ends[node]
            if token >= 0 and last < 0 and (before < 0 or self.may_follow(before, token)):
                last, change = token, tokens + 1
            if inner[node]:
                before = before if before < 0 else self._open(node, before)
                if before is not None:
                    kept.append((node, before, tokens))
        items = tuple([(n, b, t - change) for n, b, t in kept] + [(0, last, 0)])
        target = self._state(items)
        self.table[state, byte] = target
        self.change[state, byte] = change

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token data[offsets[i]:offsets[i + 1]]; all step through the table together, longest first."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = offsets[:-1][order], lengths[order]
        ascending = lengths[::-1]
        total = np.zeros(len(order), np.int64)
        state = np.full(len(order), self.start, np.int32)
        for k in range(int(lengths[0]) if len(lengths) else 0):
            live = len(ascending) - int(np.searchsorted(ascending, k, "right"))
            byte = data[begin[:live] + k]
            at = state[:live]
            after = self.table[at, byte]
            if (after < 0).any():
                if len(self.items) > MOST_STATES:
                    at = self._restart(at)
                missing = np.unique(at[self.table[at, byte] < 0].astype(np.int64) << 8 | byte[self.table[at, byte] < 0])
                for step in missing.tolist():
                    self.compile(step >> 8, step & 255)
                after = self.table[at, byte]
            total[:live] += self.change[at, byte]
            state[:live] = after
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out

    def _restart(self, at: np.ndarray) -> np.ndarray:
        """Forget all states but those that are in use."""
        used, place = np.unique(at, return_inverse=True)
        items = [self.items[s] for s in used.tolist()]
        self._clear()
        return np.array([self._state(x) for x in items], np.int32)[place]


class Counter:
    """Counts tokens as the file's tokenizer does, without added special tokens; one per Python worker."""

    def __init__(self, content: str, first: np.ndarray, kinds: np.ndarray):
        model = json.loads(content)
        body = model["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in body["merges"]]
        self.special = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        self.machine = TokenMachine({t: i for t, i in body["vocab"].items() if t not in self.special}, merges)
        self.kinds = np.repeat(kinds, np.diff(first, append=0x110000))

    def _pieces(self, text: str) -> list[str]:
        """What lies between special tokens, which the library takes out first."""
        pieces = [text]
        for s in self.special:
            if s in text:
                pieces = [x for p in pieces for x in p.split(s)]
        return pieces

    def count(self, texts: list[str]) -> np.ndarray:
        out, k = np.zeros(len(texts), np.int64), 0
        while k < len(texts):
            last, size = k, 0
            while last < len(texts) and (last == k or size + len(texts[last]) <= SLICE):
                size += len(texts[last])
                last += 1
            out[k:last] = self._count(texts[k:last])
            k = last
        return out

    def _count(self, texts: list[str]) -> np.ndarray:
        pieces = [self._pieces(t) for t in texts]
        number = np.array([len(p) for p in pieces])
        flat = [x for p in pieces for x in p]
        lengths = np.array([len(x) for x in flat], np.int64)
        whole = "".join(flat)
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        ends = np.cumsum(lengths)
        classes = np.insert(self.kinds[points], ends, END)
        starts = np.delete(pretoken_starts(classes), ends + np.arange(len(ends)))
        at = np.flatnonzero(starts)
        if not len(at):
            return number - 1
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.append((np.cumsum(width, dtype=np.int64) - width)[at], int(width.sum(dtype=np.int64)))
        data = whole.encode()
        tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        unique = tokens.dictionary_encode()
        words = unique.dictionary
        counts = self.machine.count(np.frombuffer(words.buffers()[2], np.uint8), np.frombuffer(words.buffers()[1], np.int64)[:len(words) + 1])
        owner = np.repeat(np.repeat(np.arange(len(texts)), number), lengths)[at]
        return (number - 1) + np.bincount(owner, weights=counts[unique.indices.to_numpy()], minlength=len(texts)).astype(np.int64)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str, first: np.ndarray, kinds: np.ndarray) -> Counter:
    """The counter of this worker, kept between the tasks that it runs."""
    if path not in _COUNTERS:
        _COUNTERS.clear()
        with open(path, encoding="utf-8") as file:
            _COUNTERS[path] = Counter(file.read(), first, kinds)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Adds ``n_tokens`` (long): the number of tokens of the whole text by the ``tokenizers`` file at ``path``.

    The file holds a byte-level BPE with its usual pre-tokens. No begin, end or added tokens; a special token's string inside a
    text is one token, as by the library's default. Null and empty texts have none. All rows and columns stay, repeated rows are
    counted each, a column called ``n_tokens`` is replaced, an empty table stays empty.
    """
    first, kinds = character_classes()
    names = [c for c in docs.columns if c != "n_tokens"]
    kept = F.struct(*[docs[f"`{c}`"] for c in names]) if names else F.struct(F.lit(0).alias("_"))
    frame = docs.select(kept.alias("row"), F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([frame.schema["row"], T.StructField("n_tokens", T.LongType())])

    def work(batches):
        for batch in batches:
            counts = counter(path, first, kinds).count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], schema.names)

    made = frame.mapInArrow(work, schema)
    return made.select(*[F.col("row").getField(c).alias(c) for c in names], "n_tokens")
