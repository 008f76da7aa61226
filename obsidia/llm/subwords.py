"""Byte-level BPE ids by the tokenizers library, with a bounded memory of space-separated pieces.

A byte-level BPE of this kind never merges across a single space or line feed that stands between two visible
characters, so the ids of a text are those of its pieces, each after the first with the space or line feed before it.
Nor does it merge a letter with a sentence mark or symbol after it. Most pieces recur: Arrow splits a batch of texts and
numbers its distinct pieces, a worker keeps the ids of up to CACHE pieces and has the library encode the rest, many to a
call, and numpy lays the ids of all pieces in a row. Texts that hold a special token go to the library whole.
When the memory is full, and between tasks (Spark may hold more idle workers than it has cores), a worker keeps the
pieces that came first, as a rule the most frequent.
"""

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE, IDLE = 800_000, 150_000
#: Marks that end a word without joining its last letters; an apostrophe may.
MARKS = ".,;:!?#$%&*|"
_BREAK = re.compile(r"(?<=\S) (?=\S)")
#: White space as Python and the library have it, for RE2: two in a row, or one at either end.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_WIDE = rf"{_SPACE}{{2}}|\A{_SPACE}|{_SPACE}\z"
_encoders: dict[str, "Encoder"] = {}


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode(texts): an array of ids for each text, as the library gives them by default, without special tokens added."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        n = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.n_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(n)])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}  # piece -> its place in start and size
        self.tails: dict[str, np.ndarray] = {}
        self._reset()

    def _reset(self):
        self.n, self.used = 0, 0
        self.start, self.size, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 16, self.dtype)

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Stores runs of ids, of the given sizes; the place of the first."""
        for name, need in (("start", self.n + len(sizes)), ("size", self.n + len(sizes)), ("flat", self.used + len(ids))):
            if need > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate([old, np.zeros(need, old.dtype)]))
        at = self.n
        self.start[at : at + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[at : at + len(sizes)] = sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.n, self.used = at + len(sizes), self.used + len(ids)
        return at

    def _gather(self, places: np.ndarray) -> np.ndarray:
        """The ids of the runs at these places, in a row."""
        size = self.size[places]
        shift = self.start[places] - (np.cumsum(size) - size)
        return self.flat[np.repeat(shift, size) + np.arange(int(size.sum()))]

    def _keep(self, most: int):
        """Keeps the first `most` pieces."""
        kept = list(self.known.items())[:most]
        places = np.fromiter((v for _, v in kept), np.int64, len(kept))
        ids, size = self._gather(places), self.size[places]
        self._reset()
        self._add(ids, size)
        self.known = {p: i for i, (p, _) in enumerate(kept)}

    def _learn(self, pieces: list[str]):
        """Pieces, each with a leading space but where it has its line feed. A token of byte-level BPE has a letter for
        each byte, which gives where a piece ends."""
        led = [p if p[0] == "\n" else " " + p for p in pieces]
        groups = [led[i : i + 200] for i in range(0, len(pieces), 200)]
        for i, (group, got) in enumerate(zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False))):
            ids = np.array(got.ids, dtype=np.int64)
            ends = np.cumsum(self.n_bytes[ids])
            stops = np.cumsum([len(p.encode()) for p in group])
            at = np.searchsorted(ends, stops)
            if not np.array_equal(ends[at], stops):
                raise ValueError("the tokenizer merges across spaces")
            first = self._add(ids, np.diff(at, prepend=-1))
            self.known.update(zip(pieces[200 * i : 200 * i + 200], range(first, first + len(group))))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _places(self, pieces: np.ndarray) -> np.ndarray:
        """Places of distinct pieces; unknown ones are learned, those of letters and then marks by their letters."""
        look = lambda some: np.fromiter(map(self.known.get, some, repeat(-1)), np.int64, len(some))
        places = look(pieces)
        missing = np.flatnonzero(places < 0)
        if not len(missing):
            return places
        if len(self.known) + len(missing) > CACHE:
            self._keep(CACHE // 2)
            places = look(pieces)
            missing = np.flatnonzero(places < 0)
        new = pieces[missing].tolist()
        stem = {p: q for p in new if p[-1] in MARKS and (q := p.rstrip(MARKS)).lstrip("\n").isalpha()}
        self._learn([p for p in dict.fromkeys([*(p for p in new if p not in stem), *stem.values()]) if p not in self.known])
        if stem:
            tails = []
            for p, q in stem.items():
                marks = p[len(q) :]
                if marks not in self.tails:
                    if len(self.tails) > 10_000:
                        self.tails.clear()
                    self.tails[marks] = self._whole([marks])[0]
                tails.append(self.tails[marks])
            of = look(list(stem.values()))
            n, more = self.size[of], np.fromiter(map(len, tails), np.int64, len(stem))
            ids = np.empty(int(n.sum() + more.sum()), self.dtype)
            tail = np.repeat(np.tile([False, True], len(stem)), np.stack([n, more], 1).ravel())
            ids[~tail], ids[tail] = self._gather(of), np.concatenate(tails)
            first = self._add(ids, n + more)
            self.known.update(zip(stem, range(first, first + len(stem))))
        places[missing] = look(new)
        return places

    def encode(self, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
        """The ids of each text, with end_id after them if given."""
        whole = {i: None for i, t in enumerate(texts) if any(s in t for s in self.special)}
        if whole:
            whole = dict(zip(whole, self._whole([texts[i] for i in whole])))
            texts = ["" if i in whole else t for i, t in enumerate(texts)]
        array = pa.array(texts, pa.string())
        wide = pc.match_substring_regex(array, _WIDE).to_pylist()
        split = pc.split_pattern(pc.replace_substring(array, "\n", " \n"), " ")
        if any(wide):
            split = pa.array([_BREAK.split(t) if w else s for t, w, s in zip(texts, wide, split.to_pylist())], pa.list_(pa.string()))
        offsets = split.offsets.to_numpy().astype(np.int64)
        pieces = split.flatten()
        first = np.zeros(len(pieces), dtype=bool)
        first[offsets[:-1] - offsets[0]] = True
        coded = pieces.filter(pa.array(~first)).dictionary_encode()
        places = self._places(coded.dictionary.to_numpy(zero_copy_only=False))
        n, used = self.n, self.used
        heads = self._whole(pieces.filter(pa.array(first)).to_pylist())
        if end_id is not None:
            heads.append(np.array([end_id], dtype=self.dtype))
        at = self._add(np.concatenate(heads) if heads else [], np.fromiter(map(len, heads), np.int64, len(heads)))
        self.n, self.used = n, used  # heads are not remembered
        extra = int(end_id is not None)
        bounds = offsets - offsets[0] + extra * np.arange(len(offsets))
        order = np.full(int(bounds[-1]), at + len(texts), dtype=np.int64)
        inner = np.ones(len(order), dtype=bool)
        inner[bounds[:-1]] = False
        if extra:
            inner[bounds[1:] - 1] = False
        order[bounds[:-1]] = at + np.arange(len(texts))
        order[inner] = places[coded.indices.to_numpy()]
        ids = self._gather(order)
        ends = np.concatenate([[0], np.cumsum(self.size[order])])[bounds].tolist()
        out = [ids[a:b] for a, b in zip(ends, ends[1:])]
        for i, found in whole.items():
            out[i] = np.concatenate([found, out[i]])
        return out

    def rest(self) -> None:
        """At the end of a task."""
        if len(self.known) > IDLE:
            self._keep(IDLE)


def encoder(path: str) -> Encoder:
    """One for each worker process and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
