"""Token ids of a byte-level BPE vocabulary file, and the stored table of ids that packing and token files start from."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

BYTE_BPE = "byte_bpe_50k.json"
#: Texts that are encoded together.
TEXTS = 1000


def resolve(tokenizer: str) -> str:
    """A path as it is; a bare name is looked up among the installed public tokenizer files."""
    if os.path.isabs(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def load_tokenizer(tokenizer: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(resolve(tokenizer))
    lib.no_padding()
    lib.no_truncation()
    return lib


#: A piece that ends at a line break: no white space but a leading space (as wide as Python takes it).
_LINE = re.compile(r" ?\S+")
#: Distinct pieces, and characters of them, that a worker process keeps encoded; beyond that those that came back stay.
KNOWN_PIECES, KNOWN_CHARS = 400_000, 20_000_000
#: New pieces that are encoded as one text, a line each; characters of texts that are cut together.
LINES, CHARS = 500, 4_000_000

_WHITE, _MARK, _LETTER, _BEYOND = 1, 2, 3, 4
#: Kind of a first byte: ASCII white space, other visible ASCII, ASCII letters, other visible characters.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]], _KIND[33:127], _KIND[65:91], _KIND[97:123], _KIND[0xC2:0xF5] = _WHITE, _MARK, _LETTER, _LETTER, _BEYOND
#: First bytes of Latin (C3 to C5) and Cyrillic (D0, D1) letters of two bytes; in C3 the signs of product and division are none.
_TWO = np.isin(np.arange(256), [0xC3, 0xC4, 0xC5, 0xD0, 0xD1])
_WIDE_SPACES = np.array([c for c in range(128, 65536) if chr(c).isspace()])
#: First bytes of white space beyond ASCII.
_WIDE = np.isin(np.arange(256), [chr(c).encode()[0] for c in _WIDE_SPACES])


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the byte-level split pattern cuts texts, not all of them: ``raw`` is UTF-8, texts begin at ``offsets``.

    Its matches hold either one kind of visible characters after one space at most, or white space. So it cuts between a letter
    and a mark, between visible and white, before the last of white space that precedes something visible, and after that
    one unless it is a space. What lies between such cuts has the same matches on its own.
    """
    n = len(raw)
    kind = _KIND[raw]
    wide = np.flatnonzero(_WIDE[raw])
    if len(wide):
        b0, b1, b2 = (np.take(raw, wide + k, mode="clip").astype(np.int32) & 63 for k in range(3))
        point = np.where(raw[wide] < 0xE0, (b0 & 31) << 6 | b1, (b0 & 15) << 12 | b1 << 6 | b2)
        kind[wide[np.isin(point, _WIDE_SPACES)]] = 0
    letter = kind == _LETTER
    letter[1:] |= _TWO[raw[:-1]] & ~((raw[:-1] == 0xC3) & (raw[1:] | 32 == 0xB7))
    mark, white = kind == _MARK, kind == _WHITE
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & (kind[1:] >= _MARK)
    ends = offsets[1:]
    last[ends[ends > 0] - 1] = False
    cut = last.copy()
    cut[1:] |= letter[:-1] & mark[1:] | (letter | mark)[:-1] & white[1:] | last[:-1] & (raw[:-1] != 32)
    cut[offsets[offsets < n]] = True
    return np.flatnonzero(cut)


class ByteLevelIds:
    """Ids as the tokenizers library gives them with ``add_special_tokens=False``; the library makes all of them.

    A vocabulary encodes what lies between cuts of its split pattern on its own. So texts without added tokens are cut where
    that of byte-level vocabularies always cuts, and the library encodes each distinct piece once. A piece without white space,
    but for a leading space, ends at a line break, which is an id of its own: new ones are encoded as lines of one text. Tests
    hold the ids against the library on whole texts.
    """

    def __init__(self, tokenizer: str):
        self.lib = load_tokenizer(tokenizer)
        with open(resolve(tokenizer), encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.line = self._encode(["\n"])[0]
        self.by_piece = pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and not spec.get("normalizer") and len(self.line) == 1
        self.place, self.chars = {}, 0
        self.sizes, self.starts, self.uses, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known pieces end to end, and where each begins, with the end."""
        sizes = self.sizes[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.starts[at] - upto[:-1], sizes) + np.arange(upto[-1])], upto

    def _make_room(self) -> None:
        """Keeps the pieces that were used most, more than once and in half the room."""
        pieces = list(self.place)
        kept = np.argsort(-self.uses, kind="stable")[: KNOWN_PIECES // 2]
        kept = kept[self.uses[kept] > 1]
        chars = np.cumsum(np.fromiter((len(pieces[k]) for k in kept), np.int64, len(kept)))
        kept = kept[chars <= KNOWN_CHARS // 2]
        self.place = {pieces[k]: n for n, k in enumerate(kept)}
        self.chars = int(chars[len(kept) - 1]) if len(kept) else 0
        self.flat, upto = self._ids_at(kept)
        self.sizes, self.starts, self.uses = self.sizes[kept], upto[:-1], self.uses[kept] // 2

    def _learn(self, new: list[str]) -> None:
        is_line = [bool(_LINE.fullmatch(p)) for p in new]
        lines, others = list(itertools.compress(new, is_line)), [p for p, y in zip(new, is_line, strict=True) if not y]
        found = self._encode([f"{'\n'.join(lines[at : at + LINES])}\n" for at in range(0, len(lines), LINES)])
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        breaks = ids == self.line[0]
        single = self._encode(others)
        sizes = np.concatenate([np.diff(np.flatnonzero(breaks), prepend=-1) - 1, np.fromiter(map(len, single), np.int64, len(single))])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids[~breaks], *single])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.place.update(zip(lines + others, itertools.count(len(self.place))))
        self.chars += sum(map(len, new))

    def _by_pieces(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > KNOWN_PIECES or self.chars > KNOWN_CHARS:
            self._make_room()
        _, offsets, data = pa.array(texts, pa.large_string()).buffers()
        offsets = np.frombuffer(offsets, np.int64, len(texts) + 1)
        if not offsets[-1]:
            return [np.zeros(0, np.uint32) for _ in texts]
        starts = piece_starts(np.frombuffer(data, np.uint8, offsets[-1]), offsets)
        bounds = pa.py_buffer(np.append(starts, offsets[-1]))
        coded = pa.LargeStringArray.from_buffers(len(starts), bounds, data).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        at = np.fromiter(map(self.place.get, distinct.tolist(), itertools.repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(at < 0)
        new = distinct[unknown].tolist()
        self._learn(new)
        at[unknown] = np.fromiter(map(self.place.__getitem__, new), np.int64, len(new))
        self.uses[at] += 1
        ids, upto = self._ids_at(at[coded.indices.to_numpy()])
        cuts = upto[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        whole = [not self.by_piece or any(a in t for a in self.added) for t in texts]
        entire = iter(self._encode([t for t, w in zip(texts, whole, strict=True) if w]))
        group, cut = np.cumsum([0 if w else len(t) for t, w in zip(texts, whole, strict=True)]) // CHARS, []
        for _, some in itertools.groupby(zip(group.tolist(), texts, whole, strict=True), key=lambda r: r[0]):
            cut += self._by_pieces([t for _, t, w in some if not w])
        cut = iter(cut)
        return [next(entire if w else cut) for w in whole]


@functools.lru_cache(maxsize=2)
def byte_level(tokenizer: str) -> ByteLevelIds:
    """One per worker process."""
    return ByteLevelIds(tokenizer)


def pack(ids: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """First byte: bytes an id."""
    small = not len(ids) or int(ids.max()) < 65536
    return (b"\x02" if small else b"\x04") + press.compress(ids.astype("<u2" if small else "<u4").tobytes())


def unpack(data: bytes, press: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.frombuffer(press.decompress(data[1:]), "<u2" if data[0] == 2 else "<u4")


def in_batches(rows: Iterator[tuple], schema: pa.Schema, weight, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about ``limit`` bytes; weight(row) is a row's size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row) + 32
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_TOKENS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("packed", pa.binary())])


def _token_batches(tokenizer: str, end_id: int | None):
    def rows(batches):
        encode, press = byte_level(tokenizer), zstandard.ZstdCompressor(level=1)
        end = [] if end_id is None else [end_id]
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                keys, docs, texts = (c.to_pylist() for c in batch.slice(at, TEXTS).columns)
                for key, doc, found in zip(keys, docs, encode.many(texts), strict=True):
                    ids = np.concatenate([found, np.array(end, np.uint32)])
                    yield key, doc, len(ids), pack(ids, press)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(rows(batches), _TOKENS, lambda r: len(r[3]))

    return run


def token_table(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int | None) -> DataFrame:
    """(key, doc_id, n, packed), written once to the shared folder: each text is encoded a single time.

    ``key`` is unique; its upper bits name the partition that wrote the row. Null texts count as empty.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).select(
        F.monotonically_increasing_id().alias("key"), "doc_id", "text"
    )
    return stored(keyed.mapInArrow(_token_batches(tokenizer, end_id), "key long, doc_id long, n long, packed binary"), "tokens")
