"""Periodic runs of words (maximal repetitions) by longest common extensions on suffix trees.

A run is a stretch of words with smallest period q, at least ``2 * q`` and at least ``min_words`` words long, that no
neighbouring word extends. Every run has a Lyndon word of length q among the longest Lyndon words that start at each place, for
the order of words or its reverse. So there are two candidates per place; each is extended to both sides by a longest common
extension: the depth of the lowest common ancestor of two leaves, in the suffix tree of the words for the right side and of
the reversed words for the left. The trees are built by Ukkonen's algorithm, and ancestors are found in constant time by range
minima over an Euler tour.

A run of m words or more repeats some stretch of m / 2 words at the distance of its period. Stretches without such a repeat
inside can't touch a run, so the trees are built over the others only. Documents are worked on where they lie, without a
shuffle; a task holds the trees of about ``TREE_WORDS`` words, or of one longer stretch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TREE_WORDS = 5_000


def suffix_tree(symbols: list[int], width: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's suffix tree of n symbols below ``width``, the last of which occurs once: edges, starts, ends.

    Node k < n is the leaf of suffix k, node n the root, the others are inner nodes. ``edges`` maps (node - n) * width + first
    symbol to a child. An edge's label is symbols[starts[child]:end]; the end of an inner node's is ends[node - n], a leaf's is n.
    """
    n = len(symbols)
    edges: dict[int, int] = {}
    find = edges.get
    starts, ends, links = [0] * n, [0], [0]  # leaves only, and inner nodes
    starts.append(0)
    leaf = node = length = pending = 0  # node counts from the root
    edge = 0  # where the label starts that the active point lies on
    for i, symbol in enumerate(symbols):
        pending += 1
        unlinked = 0
        while pending:
            if not length:
                edge = i
            key = node * width + symbols[edge]
            child = find(key)
            if child is None:
                edges[key] = leaf
                at = node
            else:
                start = starts[child]
                if child >= n and length >= (span := ends[child - n] - start):
                    node, edge, length = child - n, edge + span, length - span
                    continue
                follows = symbols[start + length]
                if follows == symbol:
                    length += 1
                    if unlinked:
                        links[unlinked] = node
                    break
                at = len(ends)
                starts.append(start)
                start += length
                ends.append(start)
                links.append(0)
                edges[key] = n + at
                base = at * width
                edges[base + follows] = child
                starts[child] = start
                edges[base + symbol] = leaf
            starts[leaf] = i
            leaf += 1
            if unlinked:
                links[unlinked] = at
            unlinked = at
            pending -= 1
            if node:
                node = links[node]
            elif length:
                length -= 1
                edge = i - pending + 1
    return edges, starts, ends


class Extensions:
    """Longest common extensions of any two suffixes, and the suffixes' order in both directions of the alphabet.

    ``symbols`` ends with a symbol of its own. Symbols below ``ends`` close a stretch and come first in both orders.
    """

    def __init__(self, symbols: np.ndarray, ends: int):
        n, width = len(symbols), int(symbols.max()) + 1
        edges, starts, stops = suffix_tree(symbols.tolist(), width)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        child = np.fromiter(edges.values(), np.int64, len(edges))
        self.suffixes, self.nodes = n, len(starts)
        self.parent = np.full(self.nodes, n)
        self.parent[child] = n + keys // width
        first = np.zeros(self.nodes, np.int64)
        first[child] = keys % width
        self.depth = np.concatenate([np.full(n, n), np.array(stops, np.int64)]) - np.array(starts, np.int64)
        up = self.parent.copy()
        while (up != n).any():  # string depths: labels summed towards the root by doubling
            self.depth += self.depth[up]
            up = up[up]
        self._steps = self._tour(first)
        self._backward = np.where(first < ends, first, width + ends - first)
        self.rank = self._ranks(self._steps)
        self._minima()

    def _tour(self, order: np.ndarray) -> np.ndarray:
        """Steps of the Euler tour that takes children by ``order``, by list ranking: into every node, then out of it."""
        n, root = self.nodes, self.suffixes
        nodes = np.delete(np.arange(n), root)
        by = nodes[np.lexsort((order[nodes], self.parent[nodes]))]
        last = np.ones(len(by), bool)
        last[:-1] = self.parent[by[1:]] != self.parent[by[:-1]]
        opening = np.ones(len(by), bool)
        opening[1:] = last[:-1]
        # steps 0..n-1 go down to a node, n..2n-1 leave it; leaving the root is the end
        jump = np.arange(2 * n)
        jump[:n] += n
        jump[self.parent[by[opening]]] = by[opening]
        jump[n + by[~last]] = by[1:][~last[:-1]]
        jump[n + by[last]] = n + self.parent[by[last]]
        end = n + root
        left = np.ones(2 * n, np.int64)
        left[end] = 0
        while (jump != end).any():
            left += left[jump]
            jump = jump[jump]
        return left[root] - left

    def _ranks(self, steps: np.ndarray) -> np.ndarray:
        rank = np.empty(self.suffixes, np.int64)
        rank[np.argsort(steps[:self.suffixes])] = np.arange(self.suffixes)
        return rank

    def backward_rank(self) -> np.ndarray:
        return self._ranks(self._tour(self._backward))

    def _minima(self):
        """Sparse table of minimal depths over the Euler tour between neighbouring leaves."""
        n = self.nodes
        tour = np.empty(2 * n, np.int64)
        tour[self._steps[:n]] = self.depth
        tour[self._steps[n:]] = self.depth[self.parent]
        places = np.sort(self._steps[:self.suffixes])
        level = np.minimum.reduceat(tour, places)[:-1].astype(np.int32) if len(places) > 1 else np.zeros(0, np.int32)
        self.table = [level]
        step = 1
        while 2 * step <= len(level):
            self.table.append(np.minimum(self.table[-1][:-step], self.table[-1][step:]))
            step *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols from a and from b on; a and b differ."""
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        power = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(power):
            use = power == k
            level = self.table[k]
            out[use] = np.minimum(level[low[use]], level[high[use] - (1 << int(k))])
        return out


def _lyndon_ends(rank: list[int]) -> np.ndarray:
    """For every place the end of the longest Lyndon word that starts there: the next smaller suffix."""
    ends = [len(rank)] * len(rank)
    waiting: list[int] = []
    for i, r in enumerate(rank):
        while waiting and rank[waiting[-1]] > r:
            ends[waiting.pop()] = i
        waiting.append(i)
    return np.array(ends, np.int64)


def runs_of(symbols: np.ndarray, ends: int, min_words: int) -> np.ndarray:
    """Rows (start, end, period) of all runs; ``symbols`` below ``ends`` occur once each, the last one closes the sequence."""
    n = len(symbols)
    right = Extensions(symbols, ends)
    starts = np.flatnonzero(symbols >= ends)
    found = []
    for rank in (right.rank, right.backward_rank()):
        stop = _lyndon_ends(rank.tolist())[starts]
        found.append((starts * n + stop)[symbols[stop] >= ends])
    if not sum(map(len, found)):
        return np.zeros((0, 3), np.int64)
    i, j = np.divmod(np.unique(np.concatenate(found)), n)
    after = right.common(i, j)
    del right
    # the reversed sequence keeps the closing symbol at its end
    left = Extensions(np.concatenate([symbols[-2::-1], symbols[-1:]]), ends)
    before = left.common(n - 1 - i, n - 1 - j)
    s, e, p = i - before, j + after, j - i
    good = e - s >= np.maximum(min_words, 2 * p)
    first = np.unique(s[good] * n + e[good], return_index=True)[1]  # a stretch has one smallest period
    return np.stack([s[good], e[good], p[good]], 1)[first]


def _repeating(ids: np.ndarray, group: np.ndarray, grams: int) -> np.ndarray:
    """Which words lie in a stretch of ``grams`` words that occurs twice in their group; groups are consecutive."""
    n = len(ids)
    covered = np.zeros(n + 1, np.int64)
    if n >= grams:
        key = group[:n - grams + 1].astype(np.uint64)
        for k in range(grams):
            key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k:n - grams + 1 + k].astype(np.uint64)
            key ^= key >> np.uint64(29)
        # equal hashes of unequal stretches would only keep more words than needed
        places = np.flatnonzero(group[:n - grams + 1] == group[grams - 1:])
        places = places[np.argsort(key[places], kind="stable")]
        same = key[places[1:]] == key[places[:-1]]
        twice = np.zeros(len(places), bool)
        twice[1:] |= same
        twice[:-1] |= same
        np.add.at(covered, places[twice], 1)
        np.add.at(covered, places[twice] + grams, -1)
    return np.cumsum(covered[:-1]) > 0


def find_runs(ids: np.ndarray, lengths: np.ndarray, min_words: int) -> np.ndarray:
    """Rows (document, start, length, period), sorted, of all runs of documents that lie one after the other in ``ids``."""
    first = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at, group = np.arange(len(ids)), doc
    grams = max(1, (min_words + 1) // 2)
    while len(at):  # stretches that repeat inside themselves
        keep = _repeating(ids[at], group, grams)
        kept_at, kept_group = at[keep], group[keep]
        new = np.ones(len(kept_at), bool)
        new[1:] = (np.diff(kept_at) > 1) | (np.diff(kept_group) != 0)
        group = np.cumsum(new) - 1
        done = len(kept_at) == len(at)
        sizes = np.bincount(group)[group] if len(group) else group
        at, group = kept_at[sizes >= min_words], group[sizes >= min_words]
        if done:
            break
    found = [np.zeros((0, 4), np.int64)]
    bounds = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(at) else np.zeros(1, np.int64)
    k = 0
    while k < len(bounds) - 1:
        last = max(k + 1, int(np.searchsorted(bounds, bounds[k] + TREE_WORDS, "right")) - 1)
        part, own = at[bounds[k]:bounds[last]], group[bounds[k]:bounds[last]]
        number = last - k  # stretches, each closed by a symbol of its own
        words = np.unique(ids[part], return_inverse=True)[1] + number
        closing = bounds[k + 1:last + 1] - bounds[k]
        symbols = np.insert(words, closing, np.arange(number))
        places = np.insert(part, closing, -1)
        runs = runs_of(symbols, number, min_words)
        start = places[runs[:, 0]]
        found.append(np.stack([doc[start], start - first[doc[start]], runs[:, 1] - runs[:, 0], runs[:, 2]], 1))
        k = last
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def planted(length: int, seed: int | None) -> np.ndarray | None:
    """Which words of a document of natural words make up one with known runs; None for the words as they are.

    With ``g = seed // 10``, a seed that ends in 0 lets every word from ``a = g % length`` on repeat the words from a on with
    period ``1 + (length - a) // (3 + g % 8)``.
    """
    if seed is None or seed % 10 or not length:
        return None
    g = seed // 10
    a = g % length
    words = np.arange(length)
    words[a:] = a + (words[a:] - a) % (1 + (length - a) // (3 + g % 8))
    return words


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def collapse_runs(docs: DataFrame, min_words: int = 12, text_col: str = "text", seed_col: str | None = None) -> DataFrame:
    """Adds ``runs`` (start, length and period in words, by start and period) and ``collapsed``: the text with one period of every run.

    Words are what lies between spaces and the characters 9 to 13; a null text has none. ``collapsed`` joins the words that stay
    by one space: a word goes if any run holds it after that run's first period. ``seed_col`` names a column for ``planted``; a null
    seed changes nothing. All rows and columns stay, repeated rows get equal results, an empty table stays empty; columns that
    are called like an added one are replaced.
    """
    added = ("runs", "collapsed")
    names = [c for c in docs.columns if c not in added]
    kept = F.struct(*[docs[f"`{c}`"] for c in names]) if names else F.struct(F.lit(0).alias("_"))
    seed = docs[f"`{seed_col}`"].cast("long") if seed_col else F.lit(None).cast("long")
    frame = docs.select(kept.alias("row"), F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"),
                        seed.alias("seed"))
    schema = T.StructType([frame.schema["row"], T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    run_type = pa.struct([(f.name, pa.int64()) for f in RUN])

    def work(batches):
        for batch in batches:
            split = pc.ascii_split_whitespace(batch.column(1))  # spaces and the characters 9 to 13
            words = split.flatten()
            real = pc.not_equal(words, pa.scalar("", words.type)).to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
            first = np.cumsum(lengths) - lengths
            order = np.flatnonzero(real)
            for d, seed in enumerate(batch.column(2).to_pylist()):
                places = planted(int(lengths[d]), seed)
                if places is not None:
                    own = order[first[d]:first[d] + lengths[d]]
                    own[:] = own[places]
            ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)[order]
            runs = find_runs(ids, lengths, min_words)
            gone = np.zeros(len(ids) + 1, np.int64)
            begin = first[runs[:, 0]] + runs[:, 1]
            np.add.at(gone, begin + runs[:, 3], 1)
            np.add.at(gone, begin + runs[:, 2], -1)
            stays = np.cumsum(gone[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(stays)])[np.append(first, len(ids))].astype(np.int32)
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), words.take(pa.array(order[stays]))), " ")
            offsets = np.searchsorted(runs[:, 0], np.arange(len(sizes) + 1)).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(run_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values), collapsed], schema.names)

    made = frame.mapInArrow(work, schema)
    return made.select(*[F.col("row").getField(c).alias(c) for c in names], *added)
