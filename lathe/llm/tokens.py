"""Token ids of whole texts with a public tokenizer file, fast enough for corpora.

The tokenizer in use never looks across ASCII blanks: it turns runs of white space into one
space and drops it, its word pattern excludes white space, and its other steps work on single
characters. So a text's ids are those of its blank-separated chunks, one after the other, and
a full stop or comma that ends a chunk after a letter or digit is a piece of its own. Chunks
repeat: a batch's distinct ones are found by Arrow, and frequent ones keep their ids from batch
to batch. A chunk of printable Latin-1 is cut into the tokenizer's own pieces and goes to its
model; any other chunk goes to the tokenizer whole. Memory is bounded by the batch.
"""

from __future__ import annotations

from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import WordTable

END_ID = 1

#: The word pattern of the tokenizer file, for printable Latin-1 text.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile(r"[\x21-\x7e\xa1-\xff]*+")


#: Byte-level alphabet: the character that stands for each byte (printable ones for themselves).
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_SELF))}
LATIN = {c: "".join(_BYTE[b] for b in chr(c).encode()) for c in range(0x21, 0x100)}


#: Marks that end a chunk, as far as no special token of the file ends with them; so many of them at most.
_MARK, MARKS = np.isin(np.arange(256), [ord(c) for c in ".,!?;:*#$%&"]), 8
_ASCII_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
#: Words that a batch repeats so often and their ids are kept, up to this many.
KEEP_FROM, KEEP = 4, 1 << 16


class Chunks(WordTable):
    """The chunks of many texts; the marks that end one after a letter or digit are one more."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        super().__init__(texts)
        d, last = self.data, self.end - 1
        split = _MARK[d[last]]
        some = np.flatnonzero(split & (last > self.start))
        for _ in range(MARKS - 1):  # back to the run's first mark
            some = some[_MARK[d[last[some] - 1]] & (last[some] - 1 > self.start[some])]
            last[some] -= 1
        before, lead = d[np.maximum(last - 1, 0)], d[np.maximum(last - 2, 0)]
        letter = (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (last - 2 >= self.start)
        split &= (last > self.start) & (_ASCII_ALNUM[before] | letter)
        extra = np.cumsum(split)
        at = np.arange(len(split)) + extra - split
        n = len(split) + int(split.sum())
        start, end = np.empty(n, np.int64), np.empty(n, np.int64)
        start[at], end[at] = self.start, np.where(split, last, self.end)
        mark = at[split] + 1
        start[mark], end[mark] = last[split], self.end[split]
        self.start, self.end = start, end
        self.cut = self.cut + np.concatenate(([0], extra))[self.cut]

    def values(self) -> pa.Array:
        at = np.concatenate(([0], np.cumsum(self.end - self.start)))
        body = self.data[:-8][super().inside(self.data[:-8])]
        return pa.Array.from_buffers(pa.large_string(), len(self.start), [None, pa.py_buffer(at), pa.py_buffer(body)])


def gather(values: np.ndarray, begin: np.ndarray, n: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
    """values[begin[0]], ... (n[0] of them), then those of begin[1], and so on."""
    out, done = np.empty(int(n.sum()), values.dtype), 0
    for i in range(0, len(n), at_once):
        m = n[i : i + at_once]
        end = np.cumsum(m)
        at = np.repeat(begin[i : i + at_once] - end + m, m)
        at += np.arange(len(at))
        out[done : done + len(at)] = values[at]
        done += len(at)
    return out


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known, self.known_ids, self.known_n = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def model_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case pieces, one after the other, and how many each has."""
        ids, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(pieces), 4096):  # a token is an object of some hundred bytes
            got = list(map(self.model.tokenize, pieces[i : i + 4096]))
            ids.append(np.fromiter(map(attrgetter("id"), chain.from_iterable(got)), np.uint32))
            size.append(np.fromiter(map(len, got), np.int64, len(got)))
        return np.concatenate(ids), np.concatenate(size)

    def chunk_ids(self, chunk: str) -> list[int]:
        if "<|" not in chunk and PLAIN.fullmatch(chunk):
            return [t.id for x in PIECES.findall(chunk.lower()) for t in self.model.tokenize(x if x.isascii() else x.translate(LATIN))]
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def ids_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        word = np.fromiter((x.isalpha() and (x.isascii() or max(x) <= "\xff") for x in chunks), bool, len(chunks))
        ids, n = self.model_ids([x.lower() if x.isascii() else x.lower().translate(LATIN) for x, w in zip(chunks, word.tolist(), strict=True) if w])
        if word.all():
            return ids, n
        other = [self.chunk_ids(chunks[i]) for i in np.flatnonzero(~word).tolist()]
        size = np.empty(len(chunks), np.int64)
        size[word], size[~word] = n, np.fromiter(map(len, other), np.int64, len(other))
        out, of_word = np.empty(int(size.sum()), np.uint32), np.repeat(word, size)
        out[of_word], out[~of_word] = ids, np.fromiter(chain.from_iterable(other), np.uint32)
        return out, size

    def batch(self, texts: pa.Array | pa.ChunkedArray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), each followed by ``end``, as little-endian uint32,
        and how many each text has."""
        chunks = Chunks(texts)
        coded = chunks.values().dictionary_encode()
        names, which = coded.dictionary, coded.indices.to_numpy()
        at = pc.fill_null(pc.index_in(names, value_set=self.known), -1).to_numpy()
        new = names.filter(pa.array(at < 0))
        ids, size = self.ids_of(new.to_pylist())
        all_ids, all_n = np.concatenate((self.known_ids, ids, np.array([end], np.uint32))), np.concatenate((self.known_n, size, [1]))
        begin = np.cumsum(all_n) - all_n
        at = np.where(at < 0, np.cumsum(at < 0) - 1 + len(self.known_n), at)
        # chunk by chunk, the end mark after each text's last one
        n_texts = len(chunks.cut) - 1
        rank = np.full(len(which) + n_texts, len(all_n) - 1, np.int32)
        is_chunk = np.ones(len(rank), bool)
        is_chunk[chunks.cut[1:] + np.arange(n_texts)] = False
        rank[is_chunk] = at[which]
        n = all_n[rank]
        to = np.cumsum(n)
        out = gather(all_ids, begin[rank], n)
        if len(self.known) < KEEP:
            often = np.bincount(which, minlength=len(names))
            often = np.flatnonzero((often >= KEEP_FROM) & (at >= len(self.known_n)))[: KEEP - len(self.known)]
            if len(often):
                self.known = pa.concat_arrays([self.known, names.take(pa.array(often))])
                mine, more = at[often], all_n[at[often]]
                self.known_ids = np.concatenate((self.known_ids, gather(all_ids, begin[mine], more)))
                self.known_n = np.concatenate((self.known_n, more))
        ends = np.concatenate(([0], to))[chunks.cut + np.arange(n_texts + 1)]
        return out.astype("<u4", copy=False), np.diff(ends)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a file; Spark reuses its Python workers from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
