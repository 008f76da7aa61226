"""Greedy longest-match word pieces counted by one pass of an automaton, without building the pieces."""

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from obsidia.llm.common import table, text_slices
from obsidia.llm.subwords import default_path

#: A worker remembers the counts of at most so many words.
CACHE = 600_000
END = "</w>"
#: Words within a run of visible characters: letters, single digits, other characters.
_WORDS = re.compile(r"[^\W\d_]+|\d|(?:_|[^\w\s])+")
_automata: dict[str, "Automaton"] = {}


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else the next letter from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in visible else chr(next(spare)) for b in range(256)}


def ended(word: str) -> list[str]:
    return [*word[:-1], word[-1:] + END]


class Automaton:
    """Longest-match pieces of a word in one pass over its symbols.

    A node is a prefix of some piece. fail[v] is where matching goes on once the longest pieces at the head of v's
    string are popped, pops[v] how many those are; fail < 0: no piece starts there. The last character of a word and
    END are one symbol; so a piece with END matches only there, and one without it never does.
    """

    def __init__(self, pieces):
        self.step: list[dict[str, int]] = [{}]
        final, parent = [False], [(0, "")]
        for piece in pieces:
            node = 0
            for c in ended(piece[: -len(END)]) if piece.endswith(END) else piece:
                if c not in self.step[node]:
                    self.step[node][c] = len(self.step)
                    self.step.append({})
                    final.append(False)
                    parent.append((node, c))
                node = self.step[node][c]
            final[node] = True
        self.fail, self.pops = [-1] * len(final), [0] * len(final)
        queue = list(self.step[0].values())
        for v in queue:  # breadth first: fail leads to shorter strings
            queue.extend(self.step[v].values())
            if final[v]:
                self.fail[v], self.pops[v] = 0, 1
                continue
            u, c = parent[v]
            z, pops = self.fail[u], self.pops[u]
            while z >= 0 and c not in self.step[z]:
                pops += self.pops[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.pops[v] = self.step[z][c], pops

    def count(self, word: list[str]) -> int:
        """Pieces of a word given as symbols; 1 for a word that has none (one unknown piece)."""
        step, fail, pops = self.step, self.fail, self.pops
        node = n = 0
        for c in word:
            while c not in step[node]:
                n += pops[node]
                node = fail[node]
                if node < 0 or (node == 0 and c not in step[0]):
                    return 1
            node = step[node][c]
        while node > 0:
            n += pops[node]
            node = fail[node]
        return n if node == 0 else 1


class Counter:
    """Counts of pieces in texts: lower-cased, cut at white space and into words, each ended by END."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.automaton = Automaton(model["vocab"])
        self.symbols = byte_symbols()
        self.known: dict[str, int] = {}

    def run(self, chunk: str) -> int:
        """Of a run of visible characters."""
        total = 0
        for word in _WORDS.findall(chunk.lower()):
            total += self.automaton.count(ended("".join([self.symbols[b] for b in word.encode("utf-8", "surrogatepass")])))
        return total

    def count(self, text: str) -> tuple[int, int]:
        """(words between white space, pieces)"""
        runs = text.split()
        new = {r for r in runs if r not in self.known}
        if new:
            if len(self.known) + len(new) > CACHE:
                self.known = {}
                new = set(runs)
            for r in new:
                self.known[r] = self.run(r)
        return len(runs), sum(map(self.known.__getitem__, runs))


def counter(path: str) -> Counter:
    if path not in _automata:
        _automata[path] = Counter(path)
    return _automata[path]


def _count(batches, path):
    c = counter(path)
    for part in text_slices(batches):
        got = np.array([c.count(t or "") for t in part.column("text").to_pylist()], dtype=np.int64).reshape(-1, 2)
        yield pa.record_batch([part.column("doc_id"), pa.array(got[:, 0]), pa.array(got[:, 1])], names=["doc_id", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words (runs of visible characters), n_tokens (greedy longest-match pieces) of every row.

    `path` names a vocabulary file whose pieces end a word with `</w>`. Null and empty texts count 0; a word that
    the vocabulary can't spell counts as one piece; repeated rows count each for itself; null ids stay; other
    columns are not read; an empty table gives no rows.
    """
    path = path or default_path("word_bpe_49k.json")
    return docs.select("doc_id", "text").mapInArrow(lambda it: _count(it, path), "doc_id long, n_words long, n_tokens long")


def op1_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
