"""Byte-level BPE over whole texts by way of their distinct chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Token ids as they are kept and joined.
ID = np.dtype("<i4")


class ChunkIds:
    """Token ids of texts, with the ids of chunks seen before kept in a bounded table.

    The split pattern of byte-level BPE always starts a new piece at a space between two non-blank characters, so a
    text may be cut before each such space and the chunks encoded on their own. A text in which white space touches a
    space is encoded whole. `encode` gives each text's ids as the bytes of 32-bit integers; `most` bounds the table
    (about 0.2 KB a chunk).
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], most: int = 400_000):
        self.encode, self.most, self.known = encode, most, {}

    def _learn(self, new: set[str]) -> None:
        # A blank beside the space that starts or follows a chunk: the pattern would look across the cut.
        odd = {c for c in new if c[-1].isspace() or c[0] == " " and c[1].isspace()}
        plain = list(new - odd)
        self.known.update(zip(plain, self.encode(plain)))
        self.known.update(dict.fromkeys(odd))

    def all(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text; chunks new to the table are encoded together."""
        if len(self.known) > self.most:
            self.known.clear()
        cut = []
        for text in texts:
            start, *chunks = text.split(" ")
            cut.append([start, *[" " + c for c in chunks]] if start else [" " + c for c in chunks])
        self._learn(set().union(*cut).difference(self.known))
        known, out = self.known, []
        for text, chunks in zip(texts, cut):
            parts = [known[c] for c in chunks]
            if None in parts:
                parts = self.encode([text])
            out.append(np.frombuffer(b"".join(parts), ID))
        return out

    def __call__(self, text: str) -> np.ndarray:
        return self.all([text])[0]


class WordIds:
    """Token ids of Arrow columns of texts, cut at spaces and looked up by distinct word.

    The cut is that of `ChunkIds`. A column's words are split and made distinct in Arrow; only words not seen before
    reach `after_space`, which gives the ids of each word with a space before it. `alone` gives the ids of a text on its
    own: of first words, of texts in which white space touches a space, and of texts that hold a string of `added`. Ids
    are bytes of 32-bit integers; `most` bounds the table of words (about 0.2 KB each).
    """

    def __init__(self, after_space: Callable[[list[str]], list[bytes]], alone: Callable[[str], bytes], added: Sequence[str] = (), most: int = 800_000):
        self.after_space, self.alone, self.added, self.most, self.known = after_space, alone, added, most, {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > self.most:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        # None where the pattern would look across the cut: an empty word, or a blank at either end.
        plain = [w for w in new if w and w.strip() == w]
        if len(plain) < len(new):
            self.known.update(dict.fromkeys(new))
        self.known.update(zip(plain, self.after_space(plain)))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number of ids of each text; no text is null."""
        cut = pc.split_pattern(texts, " ")
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        firsts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        self._learn(words)
        parts = list(map(self.known.__getitem__, words))

        across = np.array([p is None for p in parts], bool)[at]
        start = [words[i] for i in at[firsts]]
        across[firsts] = [w != "" and w[-1].isspace() for w in start]
        whole = np.logical_or.reduceat(across, firsts)
        for string in self.added:
            whole |= pc.match_substring(texts, string).to_numpy(zero_copy_only=False)

        # First words, and texts on their own, are entries after those of the words; the entry at the end is empty.
        alone = [self.alone(texts[i].as_py() if whole[i] else w) for i, w in enumerate(start)]
        at[np.repeat(whole, ends - firsts)] = len(words) + len(alone)
        at[firsts] = len(words) + np.arange(len(alone))
        entries = [p or b"" for p in parts] + alone + [b""]
        ids = pa.array(np.frombuffer(b"".join(entries), ID))
        sizes = np.fromiter(map(len, entries), np.int32, len(entries)) // ID.itemsize
        table = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), ids)
        found = table.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        return found, np.add.reduceat(sizes[at], firsts)
