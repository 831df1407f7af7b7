"""Many literals searched in one pass over a text: a trie with failure links, stepped for a whole batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS = 1 << 22  # bytes of padded texts that are stepped together


class Automaton:
    """Finds all literals of a set in texts; the work is one step per character, however many literals there are.

    ``step`` is the whole transition table: a state is the longest literal prefix that the text read so far ends in, and a missing
    child is the child of the failure state, filled in breadth first. Bytes that no literal has share one column and lead to the root.
    """

    def __init__(self, literals: list[bytes]):
        self.literals = sorted({t for t in literals if t})
        used = sorted({b for t in self.literals for b in t})
        self.column = np.zeros(256, dtype=np.uint8)
        self.column[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        own = [-1]
        for number, literal in enumerate(self.literals):
            at = 0
            for b in self.column[np.frombuffer(literal, np.uint8)].tolist():
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    own.append(-1)
                at = children[at][b]
            own[at] = number
        self.own = np.array(own, dtype=np.int32)
        self.step = np.zeros((len(children), len(used) + 1), dtype=np.int32)
        fail, self.shorter = np.zeros(len(children), dtype=np.int32), np.zeros(len(children), dtype=np.int32)
        level = [0]
        while level:
            below = []
            for state in level:
                if state:
                    self.step[state] = self.step[fail[state]]
                for b, child in children[state].items():
                    fail[child] = self.step[fail[state], b] if state else 0
                    # the next shorter literal that ends where this state ends
                    self.shorter[child] = fail[child] if own[fail[child]] >= 0 else self.shorter[fail[child]]
                    below.append(child)
                for b, child in children[state].items():
                    self.step[state, b] = child
            level = below
        self.ends = (self.own >= 0) | (self.shorter > 0)

    def found(self, texts: list[bytes]) -> list[list[int]]:
        """The numbers of the literals in each text, each once, in rising order."""
        out: list[list[int]] = [[] for _ in texts]
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        begin = 0
        while begin < len(order) and texts[order[begin]]:
            width = len(texts[order[begin]])
            some = order[begin : begin + max(1, CELLS // width)]
            begin += len(some)
            for i, number in self._run([texts[i] for i in some], width):
                out[some[i]].append(number)
        return out

    def _run(self, texts: list[bytes], width: int) -> list[tuple[int, int]]:
        """(text, literal) pairs, each once; the texts are sorted by falling length, so those still read are always the first."""
        sizes = np.array([len(t) for t in texts])
        columns = self.column[np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)]
        states = np.zeros(len(texts), dtype=np.int32)
        hits = []
        for at in range(width):
            live = int(np.searchsorted(-sizes, -at, side="left"))  # texts longer than ``at``
            states = self.step[states[:live], columns[:live, at]]
            if (here := np.flatnonzero(self.ends[states])).size:
                hits.append(here.astype(np.int64) * len(self.own) + states[here])
        pairs = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        text, state = np.divmod(pairs, len(self.own))
        seen = []
        while len(text):
            whole = self.own[state] >= 0
            seen.append(text[whole] * len(self.literals) + self.own[state[whole]])
            state = self.shorter[state]
            text, state = text[state > 0], state[state > 0]
        both = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        return list(zip(*(x.tolist() for x in np.divmod(both, max(1, len(self.literals)))), strict=True))


def literals_in(text: Column, literals: list[str], prefix: str = "") -> Column:
    """array<string>: the literals that occur in ``text``, each with ``prefix`` before it; empty for NULL."""
    machine = Automaton([t.encode() for t in literals])
    names = [prefix + t.decode() for t in machine.literals]

    @F.arrow_udf("array<string>")
    def search(texts: pa.Array) -> pa.Array:
        return pa.array([[names[i] for i in found] for found in machine.found([t or b"" for t in texts.to_pylist()])], pa.list_(pa.string()))

    return search(text.cast("binary"))
