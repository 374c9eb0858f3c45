"""Exact ids of a ``tokenizers`` file, with each distinct chunk encoded once.

White space is dropped by the vocabulary's own rules and no rule looks across
it, so a text's ids are those of its white-space separated chunks in order.
Chunks repeat far more often than texts do: each worker keeps a bounded
memory of chunks and only asks the library about new ones.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    import pyarrow as pa

DEFAULT_VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Chunks remembered by a worker, in each of two generations.
MEMORY = 350_000
#: Bytes of text that are looked up together.
BLOCK = 1 << 23

_SPECIAL = "<|"
#: Small and Latin-1 letters (not the signs for times and divided by), then ASCII marks but for the apostrophe.
_WORD_AND_MARKS = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]+)\Z")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


def _byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(spare)) for b in range(256))


#: Packers of short lists of ids.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, without the end id."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _spelt(self, spelt: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(spelt)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else self._pack(ids)

    def _plain(self, chunk: bytes) -> bytes | None:
        """A chunk of Latin letters is one word for the vocabulary's splitter, and lower case is all that its normaliser changes."""
        if chunk.isalpha() and chunk.islower():  # ASCII letters stand for themselves
            return self._spelt(chunk.decode())
        word = chunk.decode()
        if not word.isalpha() or max(word) > "\xff":
            return None
        return self._spelt(word.lower().encode().decode("latin-1").translate(self.letters))

    def _learn(self, chunks: Iterable[bytes]) -> None:
        hard: dict[bytes, list[bytes] | None] = {}
        now, before = self.now, self.before
        marks: dict[bytes, None] = {}
        heads: dict[bytes, bytes] = {}
        joined: list[tuple[bytes, bytes, bytes]] = []
        tokenize, last, match = self.model.tokenize, before.get, _WORD_AND_MARKS.match
        for chunk in chunks:
            ids = last(chunk)
            if ids is None:
                if chunk.isalpha() and chunk.islower():
                    own = [t.id for t in tokenize(chunk.decode())]
                    ids = _PACK[len(own)](*own) if len(own) < len(_PACK) else self._pack(own)
                elif m := match(chunk):
                    # a head has letters alone, so what is remembered for it was made by _plain
                    word, tail = m.groups()
                    head = now.get(word) or last(word) or heads.get(word)
                    if head is None:
                        head = heads[word] = self._plain(word)
                    joined.append((chunk, head, tail))
                    if tail not in now:
                        marks[tail] = None
                    continue
                else:
                    ids = self._plain(chunk)
                    if ids is None:
                        hard[chunk] = None
                        continue
            now[chunk] = ids
        ask = [*marks, *hard]
        for chunk, got in zip(ask, self.tokenizer.encode_batch([c.decode() for c in ask], add_special_tokens=False), strict=True):
            now[chunk] = self._pack(got.ids)
        for chunk, head, tail in joined:
            now[chunk] = head + now[tail]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """One value for each text, in order; a null text has none."""
        import pyarrow as pa

        return self.encode_array(pa.array(texts, pa.large_binary()).cast(pa.large_string()))

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """encode() of an Arrow array: chunks are split and told apart by Arrow, only distinct ones are looked up. A slice is not cast to long offsets: Arrow 23 misreads it."""
        import pyarrow as pa
        import pyarrow.compute as pc

        low, special = pc.ascii_lower(texts), pc.match_substring(texts, _SPECIAL)
        split = pc.ascii_split_whitespace(pc.if_else(special, texts, low) if pc.any(special).as_py() else low)
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.cast(pa.large_binary()).to_pylist()
        found = [*map(self.now.get, chunks)]
        gaps = [k for k, ids in enumerate(found) if ids is None]
        if gaps:
            if len(self.now) > MEMORY:
                self.before, self.now = self.now, {}
            # white space at an end leaves an empty chunk
            self._learn([chunks[k] for k in gaps if chunks[k]])
            now = self.now
            for k in gaps:
                found[k] = now[chunks[k]] if chunks[k] else b""
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
        ends = at[np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy())].tolist()
        data = ids.buffers()[2].to_pybytes() if at[-1] else b""
        return [data[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """The encoder of this worker."""
    return Encoder(vocabulary)


def encoded(batches: Iterable, vocabulary: str, text: str = "text") -> Iterator[tuple]:
    """From Arrow batches: (batch, first row, ids of the rows from there), some BLOCK bytes of text at a time."""
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    own = encoder(vocabulary)
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.binary_length(values).to_pylist()
        first, total = 0, 0
        for k, size in enumerate(sizes):
            total += size or 0
            if total >= BLOCK or k == len(sizes) - 1:
                yield batch, first, own.encode_array(values.slice(first, k + 1 - first))
                first, total = k + 1, 0
