"""Token ids of a public word-level BPE, worked out once for the distinct runs of a batch of texts.

The tokenizer lower-cases, drops white space and splits letters, digits and marks before it merges, so a text's ids are the
ids of its chunks between blanks one after the other, and those of a chunk the ids of its runs of letters, single digits and
runs of marks. A batch of texts is cut into runs by classes of bytes, the runs are numbered by Arrow, and ids are put together from
those of the distinct runs. Runs of letters go straight to the merges, spelt in the characters that stand for their bytes
there. Chunks whose splitting or normal form could cross such a run (characters beyond Latin-1, apostrophes, special tokens) are one
run and encoded whole.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from paperloom.llm.common import slices_of

CACHE_RUNS = 100_000
CACHE_BYTES = 64
BYTES_AT_ONCE = 1_000_000
END_ID = 1
BLANK, LETTER, DIGIT, MARK, OTHER = range(5)
_PLAIN = re.compile(r"[\x20-\x26\x28-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*").fullmatch
_RUNS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^0-9a-z\xdf-\xf6\xf8-\xff]+").findall
_LETTERS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+").fullmatch


def _class_of(byte: int) -> int:
    """Class of a byte of UTF-8. Letters of Latin-1 beyond ASCII are 0xC3 and one of 0x80 to 0xBF."""
    char = chr(byte)
    if char in " \n\t\r":
        return BLANK
    if char.isdigit() and byte < 0x80:
        return DIGIT
    if (byte < 0x80 and char.isalpha()) or byte == 0xC3 or 0x80 <= byte <= 0xBF:
        return LETTER
    return MARK if 0x20 < byte < 0x7F and char != "'" else OTHER


_CLASSES = np.array([_class_of(b) for b in range(256)], dtype=np.uint8)


def _byte_characters() -> list[str]:
    """Printable stand-ins of the 256 bytes in byte-level BPE: themselves if printable in Latin-1, the rest from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


def _packed(ids: list[int]) -> bytes:
    return array("H", ids).tobytes()


class WordTokenizer:
    """16-bit ids of whole texts; ``definition`` is the content of the tokenizer's file."""

    def __init__(self, definition: str):
        self.inner = Tokenizer.from_str(definition)
        self.merge = self.inner.model.tokenize
        self.characters = _byte_characters()
        self.known: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return _packed(self.inner.encode(text, add_special_tokens=False).ids)

    def _letters(self, run: str) -> bytes:
        spelt = run if run.isascii() else "".join(self.characters[b] for b in run.encode())
        return _packed([token.id for token in self.merge(spelt)])

    def _chunk(self, chunk: str) -> bytes:
        if not chunk.strip(" \n\t\r"):
            return b""
        if not _PLAIN(chunk) or "<|" in chunk:
            return self._whole(chunk)
        return b"".join(self._letters(run) if _LETTERS(run) else self._whole(run) for run in _RUNS(chunk.lower()))

    def _ids(self, run: bytes) -> bytes:
        """Ids of a run; those of long runs are not kept, which bounds the cache."""
        plain = run.isascii() and run.isalpha()  # most runs are
        if plain:
            run = run.lower()
        ids = self.known.get(run)
        if ids is None:
            ids = _packed([token.id for token in self.merge(run.decode())]) if plain else self._chunk(run.decode())
            if len(run) <= CACHE_BYTES:
                self.known[run] = ids
        return ids

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text; null is empty."""
        starts, pieces, sizes = _runs_of(texts.cast(pa.string()).fill_null(""))
        if len(self.known) > CACHE_RUNS:
            self.known.clear()
        found = [self._ids(run) for run in pieces.dictionary.to_pylist()]
        table = np.frombuffer(b"".join(found), dtype=np.uint16)
        lengths = np.array([len(ids) // 2 for ids in found], dtype=np.int64)
        run = pieces.indices.to_numpy()
        count = lengths[run] if len(run) else np.zeros(0, dtype=np.int64)
        total = np.append(0, np.cumsum(count))
        # the ids of a run stand together in the table
        first = (np.cumsum(lengths) - lengths)[run] - total[:-1] if len(run) else count
        ids = table[np.repeat(first, count) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, np.append(0, np.cumsum(sizes)))])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, without the end id."""
        ids, counts = self.encode_batch(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def by_size(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about a megabyte together, or are one text, since runs take more room than texts."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for low, high in slices_of(sizes, BYTES_AT_ONCE):
        yield batch.slice(low, high - low)


def _runs_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """Where the runs of a batch of texts start, the runs with their distinct ones numbered, and the bytes of each text."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    low, high = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    sizes = np.diff(offsets) if len(texts) else np.zeros(0, dtype=np.int64)
    if low == high:
        return np.zeros(0, dtype=np.int64), pa.array([], pa.binary()).dictionary_encode(), sizes
    data = texts.buffers()[2].slice(low, high - low)
    byte = np.frombuffer(data, dtype=np.uint8)
    kind = _CLASSES[byte]
    first = np.zeros(len(byte), dtype=bool)
    first[(offsets[:-1] - low)[sizes > 0]] = True
    # signs of multiplication and division are no letters, and special tokens begin with <|
    after = np.append(0, byte[:-1])
    other = (kind == OTHER) | ((after == 0xC3) & ((byte == 0x97) | (byte == 0xB7))) | ((after == 0x3C) & (byte == 0x7C))
    if other.any():
        chunk = np.cumsum(first | (kind == BLANK))
        whole = np.zeros(int(chunk[-1]) + 1, dtype=bool)
        whole[chunk[other]] = True
        kind[whole[chunk] & (kind != BLANK)] = OTHER
    first[1:] |= kind[1:] != kind[:-1]
    first |= kind == DIGIT
    starts = np.flatnonzero(first)
    edges = np.append(starts, len(byte)).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), data])
    return starts, runs.dictionary_encode(), sizes


def shared_tokenizer(definition: str) -> WordTokenizer:
    """The tokenizer of this worker process, kept with what it has met from one task to the next.

    It is held by a module of the process, since the code of a task is unpacked anew for each.
    """
    made = sys.modules.setdefault("paperloom_tokenizers", ModuleType("paperloom_tokenizers")).__dict__
    if definition not in made:
        made[definition] = WordTokenizer(definition)
    return made[definition]


def definition_of(path: str) -> str:
    """Content of the tokenizer's file, read on the driver and sent to the tasks; a few megabytes, whatever the data."""
    with open(path, encoding="utf-8") as file:
        return file.read()
