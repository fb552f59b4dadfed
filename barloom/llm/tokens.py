"""Token ids of whole texts by a public tokenizer, with the pieces of a text encoded once per worker.

Both vocabularies split a text into pieces before merging, and no merge crosses a piece. A text whose only white space
is single spaces and line feeds between other characters is cut at these, where every piece rule of the two
vocabularies cuts as well; Arrow cuts the texts of a call and numbers their distinct words, so that each is looked up once
a call, and the ids of a word are remembered. Words not seen before go to the library in one batch. All other texts go
to the library whole, and so do those that hold the string of a special token, which the library reads as that token
wherever it stands.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts whose white space is not as simple as above, for RE2.
ODD_SPACE = r"\A[ \n]|[ \n]\z|[ \n][ \n]|[{}]".format("".join(
    rf"\x{{{i:x}}}" for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"))
#: Remembered words per worker process. It bounds memory (about 200 MB); results do not depend on it.
CACHE_PIECES = 1_000_000
#: Unseen pieces joined into one string for the library, with a separator between that is a piece of its own.
JOINED = 50

_ENCODERS: dict = {}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids (bytes)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A vocabulary that keeps white space has a space as first character of the piece after it.
        self.keeps_space = self.library([" a"]) != self.library(["a"])
        self.known: dict[str, bytes] = {}
        self.mark, self.between = ("\n", "\n") if self.keeps_space else ("\x02", " \x02 ")
        self.mark_id = np.frombuffer(self.library([self.mark])[0], "<u4")
        self.joins = len(self.mark_id) == 1
        self.stops = dict(zip(".,", self.library([".", ","])))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [x.ids for x in encode(texts, add_special_tokens=False)]

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(ids, "<u4").tobytes() for ids in self._ids(texts)]

    def odd(self, texts: pa.Array) -> list[bool]:
        """Which texts have white space that is not as simple as above or hold a special token."""
        out = pc.match_substring_regex(texts, ODD_SPACE)
        for t in self.special:
            out = pc.or_(out, pc.match_substring(texts, t))
        return out.to_pylist()

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without the mark, many of them in one string; a group that does not come apart again is taken singly."""
        if not self.joins:
            return self.library(pieces)
        out, groups = [], [pieces[i:i + JOINED] for i in range(0, len(pieces), JOINED)]
        for group, ids in zip(groups, self._ids([self.between.join(g) for g in groups])):
            ids = np.asarray(ids, "<u4")
            stops = np.append(np.flatnonzero(ids == self.mark_id[0]), len(ids)).tolist()
            if len(stops) != len(group):
                out += self.library(group)
                continue
            raw, start = ids.tobytes(), 0
            for stop in stops:
                out.append(raw[4 * start:4 * stop])
                start = stop + 1
        return out

    def _tokens(self, words: list[str]) -> list[bytes]:
        """Ids of words. A vocabulary that keeps white space has a space before each, or where it stands, the line feed."""
        pieces = [w[1:] if w[0] == "\n" else " " + w for w in words] if self.keeps_space else words
        marked = [i for i, p in enumerate(pieces) if self.mark in p]
        alone = dict(zip(marked, self.library([pieces[i] for i in marked])))
        joined = iter(self._joined([p for i, p in enumerate(pieces) if i not in alone]))
        out = [alone[i] if i in alone else next(joined) for i in range(len(pieces))]
        if not self.keeps_space:
            return out
        start = self.mark_id.tobytes()
        return [start + ids if w[0] == "\n" else ids for w, ids in zip(words, out)]

    def learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Ids of words not seen before."""
        # A stop after an ASCII letter is a piece of its own in both vocabularies; lower case may add a mark to other letters.
        ends = [w for w in fresh if w[-1:] in (".", ",") and w[-2:-1].isascii() and w[-2:-1].isalpha() and (self.keeps_space or self.mark not in w)]
        wanted = [w[:-1] for w in ends if w[:-1] not in self.known]
        plain = list(dict.fromkeys([*set(fresh).difference(ends), *wanted]))
        out = dict(zip(plain, self._tokens(plain)))
        for w in ends:
            word = self.known.get(w[:-1])
            out[w] = (out[w[:-1]] if word is None else word) + self.stops[w[-1]]
        return out

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of simple white space; a vocabulary that keeps it has the line feed at the start of the word after it."""
        if self.keeps_space:
            cut = ["\n" + t.replace("\n", " \n") for t in texts]
        else:
            cut = [t.replace("\n", " ") for t in texts]
        lists = pc.split_pattern(pa.array(cut, pa.large_string()), " ")
        of = lists.flatten().dictionary_encode()
        words = of.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, words))
        fresh = [i for i, x in enumerate(ids) if x is None]
        if fresh:
            learned = self.learn([words[i] for i in fresh])
            for i in fresh:
                ids[i] = learned[words[i]]
            if len(self.known) + len(learned) <= CACHE_PIECES:
                self.known.update(learned)
        # the ids of every word in place: words lie one after the other in flat
        flat, size = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = of.indices.to_numpy()
        first, n = (np.cumsum(size) - size)[at], size[at]
        stop = np.cumsum(n)
        out = flat[np.repeat(first - (stop - n), n) + np.arange(stop[-1])]
        bounds = np.concatenate([[0], stop])[lists.offsets.to_numpy()].tolist()
        skip = len(self.mark_id) if self.keeps_space else 0  # the line feed set before the first word
        return [out[a + skip:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        odd = self.odd(pa.array(texts, pa.large_string()))
        for of, ids in ((self.library, [i for i, t in enumerate(texts) if odd[i]]), (self._by_words, [i for i, t in enumerate(texts) if t and not odd[i]])):
            if ids:
                for i, x in zip(ids, of([texts[i] for i in ids])):
                    out[i] = x
        return out


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
