"""Byte-pair encoding as a bounded-lookahead streaming transducer, and an incremental decoder.

The encoder reads a pre-token's bytes from left to right and keeps, for each byte position, the token
that ends there in the encoding of the bytes so far: the one whose pair with the token before it merges no
further. A token of the whole pre-token ends within any `lookahead` successive bytes (the longest token
that the merge list makes), and what stands before an end of a token is the encoding of just those bytes. So
what the encodings of the last `lookahead` prefixes share is stable: it is emitted and forgotten, and no more
than a few lookaheads are held. Frequent pre-tokens are kept in a memo of bounded size; long texts are cut
into pre-tokens lazily and their ids are handed on in blocks, so memory does not grow with a text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from comptoir.llm.shared import appended, table
from comptoir.llm.tokens import BYTE_BPE, ChunkEncoder, byte_letters

_W = r"\p{White_Space}"
#: The byte-level pattern of the vocabulary, with white space spelled out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|{_W}+(?!\P{{White_Space}})|{_W}+"
#: Letters or ids handled at once; letters from which a text is encoded on its own, in blocks.
BLOCK, LONG_TEXT = 1 << 16, 1 << 20
NONE = 1 << 60
#: Sizes of a token that the last four bytes do not tell.
SHORT = (3, 2, 1)


class Transducer(ChunkEncoder):
    """encode_many(texts) -> the ids of each as bytes; decode(blocks of ids) -> parts of the text."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        super().__init__("<u4", spaced=True)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = whole["model"]["vocab"]
        self.ids = {raw(s): i for s, i in vocab.items()}
        merges = [(raw(a), raw(b)) for a, b in (m if isinstance(m, list) else m.split(" ") for m in whole["model"]["merges"])]
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.ranks = {self.ids[a] << 32 | self.ids[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [self.ids[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.lookahead = max(len(a) + len(b) for a, b in merges)
        ends: dict[bytes, set[int]] = {}
        for b in self.ids:
            if len(b) > 3:
                ends.setdefault(b[-4:], set()).add(len(b))
        self.sizes = {end: (*sorted(of, reverse=True), *SHORT) for end, of in ends.items()}
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.decimal = [f"{i},".encode() for i in range(len(self.bytes))]
        self.fits = lru_cache(1 << 18)(self._fits)

    def _merge(self, word: bytes) -> list[int]:
        """The ids of a whole word: the pair of least rank is merged until none is left."""
        ids, get = [self.single[b] for b in word], self.ranks.get
        ranks = [get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            ids[i : i + 2] = (self.made[least],)
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], NONE)
        return ids

    def _fits(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes is just these two. Not if their own pair merges, which is the commonest case."""
        return (a << 32 | b) not in self.ranks and self._merge(self.bytes[a] + self.bytes[b]) == [a, b]

    def stream(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """The ids of one pre-token that comes in blocks of bytes, emitted as they become stable."""
        last: list[int] = []  # the token that ends at each position since the last stable end
        word, done = b"", 0  # bytes held, those before `done` settled
        ids, fits, sizes, longest = self.ids.get, self.fits, self.sizes.get, self.lookahead
        for block in blocks:
            word, done = word[done:] + block, 0
            for end in range(len(last) + 1, len(word) + 1):
                for size in sizes(word[end - 4 : end], SHORT) if end - done > 3 else SHORT:
                    if (start := end - size) >= done and (token := ids(word[start:end])) is not None and (start == done or fits(last[start - 1 - done], token)):
                        break
                else:
                    raise AssertionError("some token ends at each byte")
                last.append(token)
                if len(last) >= 4 * longest:
                    stable = self._shared(last)
                    yield from self._back(last, stable)
                    del last[:stable]
                    done += stable
        yield from self._back(last, len(last))

    def _shared(self, last: list[int]) -> int:
        """The latest end of a token that the encodings of the last `lookahead` prefixes have in common."""
        ends = set(range(len(last) - self.lookahead, len(last) + 1))
        while len(ends) > 1:  # the latest end gives way to the one before its token
            top = max(ends)
            ends.discard(top)
            ends.add(top - len(self.bytes[last[top - 1]]))
        return ends.pop()

    def _back(self, last: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end - 1])
            end -= len(self.bytes[last[end - 1]])
        return out[::-1]

    def model(self, parts: list[str]) -> list[bytes]:
        return [array("I", self.stream((p.encode(),))).tobytes() for p in parts]

    def parts(self, text: str) -> Iterator[str]:
        """Pre-tokens and special tokens, found one after the other."""
        begin = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield from (x[0] for x in self.pattern.finditer(text, begin, m.start()))
            yield m[0]
            begin = m.end()
        yield from (x[0] for x in self.pattern.finditer(text, begin))

    def blocks(self, text: str, block: int = BLOCK) -> Iterator[np.ndarray]:
        """The ids of a text in blocks made from about `block` letters each, or from one longer pre-token in blocks of its own."""
        held, n = [], 0
        for part in self.parts(text):
            if len(part) >= block and part not in self.special:
                if held:
                    yield self._ids(held)
                ids = self.stream(part[i : i + block].encode() for i in range(0, len(part), block))
                while some := list(islice(ids, block)):
                    yield np.array(some, np.uint32)
                held, n = [], 0
            else:
                held.append(part)
                n += len(part)
                if n >= block:
                    yield self._ids(held)
                    held, n = [], 0
        if held:
            yield self._ids(held)

    def _ids(self, parts: list[str]) -> np.ndarray:
        special = self.special
        plain = iter(self.token([p for p in parts if p not in special]))
        return np.frombuffer(b"".join([array("I", [special[p]]).tobytes() if p in special else next(plain) for p in parts]), np.uint32)

    def whole(self, strings: list[str]) -> list[bytes]:
        """Any strings: special tokens are cut out before the pattern."""
        out = []
        for s in strings:
            got = []
            for part in self.cut.split(s) if self.cut else [s]:
                if part in self.special:
                    got.append(array("I", [self.special[part]]).tobytes())
                else:
                    got += self.token(self.pattern.findall(part))
            out.append(b"".join(got))
        return out

    def decode(self, blocks: Iterator[np.ndarray]) -> Iterator[str]:
        """The text of blocks of ids; bytes of an unfinished letter wait for the next block, malformed ones become U+FFFD."""
        state, get = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes.__getitem__
        for ids in blocks:
            yield state.decode(b"".join(map(get, ids.tolist())))
        yield state.decode(b"", True)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One for each Python worker and file."""
    return Transducer(path)


def encoded(docs: DataFrame, path: str = BYTE_BPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids), ids little-endian of 32 bits. Null and empty texts have none; repeated rows stay; other columns are dropped."""

    def make(texts: list[str | None]) -> list:
        ids = transducer(path).encode_many(texts)
        return [[len(x) // 4 for x in ids], ids]

    return appended(docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text"), "text", {"n_tokens": "long", "ids": "binary"}, lambda: make, drop=True)


def decoded(tokens: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids). Null ids are an empty text."""

    def make(ids: list[bytes | None]) -> list:
        return [["".join(transducer(path).decode(iter([np.frombuffer(x or b"", "<u4")]))) for x in ids]]

    return appended(tokens.select("doc_id", "ids"), "ids", {"text": "string"}, lambda: make, drop=True)


def digests(docs: DataFrame, path: str = BYTE_BPE, doc_id: str = "doc_id", text: str = "text", long: int = LONG_TEXT) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded again as it streams. Short texts are encoded in blocks of several, those of `long` letters or more in blocks of their own; no block's ids are kept. Null and empty texts have no ids; repeated rows stay; other columns are dropped."""

    def one(made: Transducer, blocks: Iterable[np.ndarray]) -> tuple[int, str, str]:
        n, count, back = 0, hashlib.sha256(), hashlib.sha256()

        def seen() -> Iterator[np.ndarray]:
            nonlocal n
            for ids in blocks:
                decimal = b"".join(map(made.decimal.__getitem__, ids.tolist()))
                count.update(b"," + decimal[:-1] if n else decimal[:-1])
                n += len(ids)
                yield ids

        for piece in made.decode(seen()):
            back.update(piece.encode())
        return n, count.hexdigest(), back.hexdigest()

    def split(raw: bytes) -> Iterator[np.ndarray]:
        ids = np.frombuffer(raw, "<u4")
        return (ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK))

    def make(texts: list[str | None]) -> list:
        made = transducer(path)
        short = made.encode_each([t for t in texts if len(t or "") < long])
        return list(zip(*[one(made, split(next(short)) if len(t or "") < long else made.blocks(t)) for t in texts], strict=True))

    columns = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return appended(docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text"), "text", columns, lambda: make, drop=True)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), one for each row of documents; null and empty texts have no ids."""
    return digests(table(spark, sf_dir, "documents"))
