"""Token ids by the tokenizers library, a chunk at a time.

A text is cut at single spaces (or white space) where its tokenizer never joins what stands on the two
sides; the chunks' ids are kept in a memo of bounded size and joined. That gives the library's own ids
for the whole text and encodes a frequent word once. Nothing of a text is dropped.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from comptoir.llm.shared import appended

#: Chunks in a generation of the memo (there are two); longer chunks are encoded but not kept; letters of text in a block.
KEEP, LONG, TEXT = 200_000, 256, 4_000_000
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
_CLOSE, _SPACE = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Chunks of these letters alone are cut as the two vocabularies' patterns cut them; all others go to the library whole.
_CHUNK = re.compile(rf"(?!\n)[\n!-&(-;=-~{_LATIN}]+(?<!\n)")
_SPACED = re.compile(rf" ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
_BARE = re.compile(rf" |[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+")
FIRST = "\x00"


def byte_letters() -> dict[str, int]:
    """The byte that byte-level vocabularies mean by a letter: itself if printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo:
    """encode(list of chunks) -> list of values other than None, kept for the last KEEP to 2 * KEEP chunks."""

    def __init__(self, encode: Callable[[list[str]], list], keep: int = KEEP) -> None:
        self.encode, self.keep, self.new, self.old = encode, keep, {}, {}

    def __call__(self, chunks: list[str]) -> list:
        new, old = self.new, self.old
        out = list(map(new.get, chunks))
        if None not in out:
            return out
        open_ = [i for i, v in enumerate(out) if v is None]
        missing = []
        for c in {chunks[i] for i in open_}:
            if (got := old.get(c)) is not None:
                new[c] = got
            else:
                missing.append(c)
        if missing:
            new.update(zip(missing, self.encode(missing), strict=True))
        for i in open_:
            out[i] = new[chunks[i]]
        for c in missing:
            if len(c) > LONG:
                del new[c]
        if len(new) > self.keep:
            self.old, self.new = new, {}
        return out


def space_chunks(text: str) -> tuple[str, list[str]]:
    """The first chunk, and the others without the single space before each; a byte-level pattern ends a token before such a space."""
    if _CLOSE.search(text) or text[:1] == " " or text[-1:] == " ":
        first, *rest = _SPACE.split(text)
    else:
        first, *rest = text.split(" ")
    return first, rest


class ChunkEncoder:
    """encode_many(texts) -> the ids of each as bytes of `dtype`. spaced: the vocabulary writes a word with the space before it.

    In blocks of about TEXT letters, the distinct chunks between spaces are cut once as the pattern cuts
    them, a memo gives the ids of each pre-token, and a text's ids are gathered by chunk. A chunk of unusual letters
    is encoded whole; a text where spaces touch white space is cut with more care.
    """

    def __init__(self, dtype: str, spaced: bool) -> None:
        self.dtype, self.spaced = np.dtype(dtype), spaced
        self.token, self.odd = Memo(self._tokens), Memo(self.whole)

    def model(self, parts: list[str]) -> list[bytes]:
        """Ids of pre-tokens."""
        raise NotImplementedError

    def whole(self, strings: list[str]) -> list[bytes]:
        """Ids of any strings."""
        raise NotImplementedError

    def _tokens(self, parts: list[str]) -> list[bytes]:
        if self.spaced or " " not in parts:
            return self.model(parts)
        got = dict(zip(words := [p for p in parts if p != " "], self.model(words), strict=True))
        return [got.get(p, b"") for p in parts]

    def _odd(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of unusual chunks, None for one that touches white space; FIRST marks one without a space before it."""
        if not self.spaced:
            return self.odd(chunks)
        bare = [c[1:] if c[:1] == FIRST else c for c in chunks]
        bad = [not b or b[0].isspace() or b[-1].isspace() or FIRST in b for b in bare]
        ids = iter(self.odd([b if c[:1] == FIRST else " " + b for c, b, x in zip(chunks, bare, bad, strict=True) if not x]))
        return [None if x else next(ids) for x in bad]

    def encode_each(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, made and held for a block of texts at a time."""
        begin, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= TEXT or i + 1 == len(texts):
                yield from self._block([t or "" for t in texts[begin : i + 1]])
                begin, held = i + 1, 0

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        return list(self.encode_each(texts))

    def _block(self, texts: list[str]) -> list[bytes]:
        strings = [FIRST + t for t in texts] if self.spaced else [t.replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts]
        lists = pc.split_pattern(pa.array(strings, pa.large_string()), " ")
        words = lists.values.dictionary_encode()
        held = words.dictionary
        chunks = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held.cast(pa.string())), " ")[0].as_py().split(" ")
        fits = [m is not None for m in map(_CHUNK.fullmatch, chunks)]
        plain, odd = list(compress(chunks, fits)), [c for c, f in zip(chunks, fits, strict=True) if not f]
        size, raw = np.zeros(len(chunks), np.int64), []
        place = np.argsort(~np.array(fits, bool), kind="stable")  # plain chunks, then odd ones
        if plain:
            parts = (_SPACED if self.spaced else _BARE).findall(" " + " ".join(plain) if self.spaced else " ".join(plain).lower())
            begins = [i for i, p in enumerate(parts) if p[0] == " "]
            raw = self.token(parts)
            size[place[: len(plain)]] = np.add.reduceat(np.fromiter(map(len, raw), np.int64, len(raw)), begins if self.spaced else [0, *begins])
        others = self._odd(odd)
        size[place[len(plain) :]] = [len(x or b"") for x in others]
        size //= self.dtype.itemsize
        start = np.empty(len(chunks), np.int64)
        start[place] = np.cumsum(size[place]) - size[place]
        code = words.indices.to_numpy()
        n = size[code]
        total = np.concatenate(([0], np.cumsum(n)))
        pool = np.frombuffer(b"".join([*raw, *(x or b"" for x in others)]), self.dtype)
        ids = pool[np.repeat(start[code] - total[:-1], n) + np.arange(total[-1])].tobytes()
        bounds = lists.offsets.to_numpy()
        ends = (total[bounds] * self.dtype.itemsize).tolist()
        out = [ids[a:b] for a, b in zip(ends, ends[1:])]
        if None in others:
            bad = np.zeros(len(chunks), np.int64)
            bad[place[len(plain) :]] = [x is None for x in others]
            marks = np.concatenate(([0], np.cumsum(bad[code])))[bounds]
            for i in np.flatnonzero(np.diff(marks)):
                out[i] = self._slow(texts[i])
        return out

    def _slow(self, text: str) -> bytes:
        first, rest = space_chunks(text) if text else ("", [])
        return b"".join(self.odd([first, *(f" {c}" for c in rest)]))


class Encoder(ChunkEncoder):
    """By the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spaced = '"ByteLevel"' in self.library.decoder.__getstate__().decode() if self.library.decoder else False
        super().__init__("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4", spaced)
        self.letters = {b: c for c, b in byte_letters().items()}

    def model(self, parts: list[str]) -> list[bytes]:
        """The library's model alone, on pre-tokens written in the vocabulary's letters for bytes."""
        letters, tokenize, kind = self.letters, self.library.model.tokenize, self.dtype.char
        words = [p.replace(" ", letters[32]).replace("\n", letters[10]) if p.isascii() else "".join([letters[b] for b in p.encode()]) for p in parts]
        return [array(kind, [t.id for t in tokenize(w)]).tobytes() for w in words]

    def whole(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return Encoder(path)


def tokenised(docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (pid, at, doc_id, n, ids): a document's ids with end_id, where it stands among the tokens of its partition.

    ids are little-endian, of two bytes if the vocabulary allows. Null and empty texts hold end_id alone.
    """

    def start() -> Callable[[list], list]:
        enc, pid, at = encoder(path), TaskContext.get().partitionId(), 0
        end, size = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize

        def make(texts: list[str | None]) -> list:
            nonlocal at
            ids = [x + end for x in enc.encode_many(texts)]
            n = np.fromiter((len(x) // size for x in ids), np.int64, len(ids))
            before, at = at, at + int(n.sum())
            return [np.full(len(ids), pid), before + np.cumsum(n) - n, n, ids]

        return make

    made = {"pid": "int", "at": "long", "n": "long", "ids": "binary"}
    return appended(docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text"), "text", made, start, drop=True)


def bases(totals: list[tuple[int, int]]) -> dict[int, int]:
    """Tokens before each partition, from (partition, tokens) of all: two numbers for each partition reach the driver."""
    out, before = {}, 0
    for pid, n in sorted(totals):
        out[pid], before = before, before + n
    return out
