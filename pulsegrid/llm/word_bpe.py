"""BPE with word ends through a distinct-word table.

1. Texts are split into words (normalised as the vocabulary file says) in blocks; each distinct word of a block is a row with
   its number there.
2. The rows meet by word, whatever block they come from, and each distinct word of the corpus is encoded once.
3. Ids go back to the blocks, by the word's number, packed by task and block, and to the documents, by position.
4. Decoding joins ids with the id-to-piece table where the ids are put together: the table is as long as the vocabulary,
   whatever the corpus, and every task holds it. As rows of a shuffled join the ids would be many times the input.

Texts are read and split twice, once for words and once for positions, because a stored copy of the positions would cost
more disk than the second reading costs time. Blocks are numbered by partition and carry a checksum of their words; the
two readings are matched by both, and a block whose words are missing or others is an error.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .tokens import in_batches, load_tokenizer, pack, unpack

WORD_BPE = "word_bpe_49k.json"
BLOCK_CHARS = 8_000_000

# fixed value: the split pattern of the vocabulary file, with its classes written out for lower-case Latin-1
_LATIN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    r"|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)


class Words:
    """Splits texts as the vocabulary file's normaliser and pre-tokeniser do, and encodes words."""

    def __init__(self, tokenizer: str):
        self.lib = load_tokenizer(tokenizer)
        self.added = sorted({t.content for t in self.lib.get_added_tokens_decoder().values()}, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None

    def _part(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return _LATIN.findall(text.lower())
        except UnicodeEncodeError:
            pass
        whole = self.lib.normalizer.normalize_str(text)
        return [whole[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(whole)]

    def split(self, text: str) -> list[str]:
        if self.cut is None or not any(a in text for a in self.added):
            return self._part(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.added else self._part(part)
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(words, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def word_level(tokenizer: str) -> Words:
    """One per worker process."""
    return Words(tokenizer)


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_WORDS = pa.schema([("word", pa.string()), ("block", pa.int64()), ("place", pa.int32())])
_CODES = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary()), ("places", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])
_CODES_SQL = "block long, docs array<bigint>, counts array<bigint>, codes binary, places binary, sizes binary, ids binary"
#: Ids that a task packs at a time.
PACKED = 2_000_000


def _blocks(batches, split):
    """(block, documents, word counts, distinct words in order, places of all positions among them) of consecutive rows.

    A block is named by its partition, its number there and its words, so that two readings that differ never meet.
    Rows bring the number of their partition: a task's own number is another one where the plan is a branch of a union.
    """

    def block():
        words = list(slots)
        order = sorted(range(len(words)), key=words.__getitem__)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        words = [words[k] for k in order]
        name = xxhash.xxh64_intdigest(f"{part}:{number}:" + "\n".join(words)) >> 1
        return name, docs, counts, words, place[np.concatenate(codes)]

    part, number = 0, 0
    slots, docs, counts, codes, chars = _Slots(), [], [], [], 0
    for batch in batches:
        for doc, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = split(text)
            docs.append(doc)
            counts.append(len(words))
            codes.append(np.fromiter(map(slots.__getitem__, words), np.int32, len(words)))
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield block()
                slots, docs, counts, codes, chars, number = _Slots(), [], [], [], 0, number + 1
    if docs:
        yield block()


def _word_batches(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, words, _ in _blocks(batches, word_level(tokenizer).split):
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                columns = [pa.array(part), pa.array(np.full(len(part), block)), pa.array(np.arange(at, at + len(part), dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, schema=_WORDS)

    return run


def _code_batches(tokenizer: str):
    def rows(batches):
        press = zstandard.ZstdCompressor(level=3)
        for block, docs, counts, _, places in _blocks(batches, word_level(tokenizer).split):
            yield block, docs, counts, pack(places, press), None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(rows(batches), _CODES, lambda r: len(r[3]))

    return run


def _encode_batches(tokenizer: str):
    """Rows sorted by word: a word is encoded where it is first met; its ids go to every block that has it."""

    def rows(batches):
        encode, press = word_level(tokenizer).encode, zstandard.ZstdCompressor(level=3)
        last, known = None, {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            block, place, sizes, flat = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((place, block))
            starts = np.cumsum(sizes) - sizes
            block, place, sizes, starts = block[order], place[order], sizes[order], starts[order]
            ends = np.cumsum(sizes)
            flat = flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(len(flat))]
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(block)], strict=True):
                steps = np.diff(place[a:b], prepend=0)
                yield int(block[a]), None, None, None, pack(steps, press), pack(sizes[a:b], press), pack(flat[ends[a] - sizes[a] : ends[b - 1]], press)

        for batch in batches:
            words = batch.column(0).to_pylist()
            known = {last: known[last]} if last in known else {}
            new = [w for w in dict.fromkeys(words) if w not in known]
            known.update(zip(new, encode(new), strict=True))
            last = words[-1] if words else last
            found = [known[w] for w in words]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(sizes.sum()))
            held.append((batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64), sizes, flat))
            size += len(flat)
            if size > PACKED:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(rows(batches), _CODES, lambda r: len(r[4]) + len(r[5]) + len(r[6]))

    return run


def pieces_of(tokenizer: str) -> list[str]:
    """Piece by id: the id-to-piece table, as long as the vocabulary."""
    lib = load_tokenizer(tokenizer)
    if lib.decoder is not None:
        raise ValueError("only vocabularies without a decoder, whose pieces are joined by spaces, are decoded here")
    out = [""] * lib.get_vocab_size(with_added_tokens=True)
    for piece, i in lib.get_vocab(with_added_tokens=True).items():
        out[i] = piece
    return out


_DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def _assemble(tokenizer: str):
    """Rows sorted by block, the block's own row last: the ids of its words, then their places in its documents."""

    def rows(batches):
        expand, pieces = zstandard.ZstdDecompressor(), np.array(pieces_of(tokenizer), object)
        held, own = [], None
        for batch in batches:
            for block, docs, counts, codes, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and block != own:
                    raise RuntimeError("two readings of the input gave different blocks")
                own = block
                if docs is None:
                    held.append([unpack(x, expand) for x in packed])
                    continue
                at = np.concatenate([np.cumsum(h[0], dtype=np.int64) for h in held] or [np.zeros(0, np.int64)])
                sizes = np.concatenate([h[1] for h in held] or [np.zeros(0)]).astype(np.int64)
                flat = np.concatenate([h[2] for h in held] or [np.zeros(0)]).astype("<u4")
                places, held = unpack(codes, expand), []
                n_words = int(places.max()) + 1 if len(places) else 0
                if len(at) != n_words or (np.bincount(at, minlength=n_words) != 1).any():
                    raise RuntimeError("two readings of the input gave different blocks")
                starts, by_place = np.empty(n_words, np.int64), np.empty(n_words, np.int64)
                starts[at], by_place[at] = np.cumsum(sizes) - sizes, sizes
                yield from _documents(docs, counts, places, starts, by_place, flat, pieces)
        if held:
            raise RuntimeError("two readings of the input gave different blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(rows(batches), _DECODED, lambda r: len(r[1]) + len(r[2]))

    return run


def _documents(docs: list, counts: list[int], places: np.ndarray, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, pieces: np.ndarray) -> Iterator[tuple]:
    here = 0
    for doc, n in zip(docs, counts, strict=True):
        own = places[here : here + n]
        here += n
        many = sizes[own]
        ends = np.cumsum(many)
        ids = flat[np.repeat(starts[own] - (ends - many), many) + np.arange(int(ends[-1]) if n else 0)]
        yield doc, ids.tobytes(), " ".join(pieces[ids].tolist())


def word_bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_BPE) -> DataFrame:
    """(doc_id, ids, decoded): one row per input row; ids are little-endian uint32 bytes.

    Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows and ids stay; a null id
    stays null; an empty table gives an empty table; other columns are not read. A very common word is one row per block.
    Partitions grow with those of the input, so no task's share does.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.spark_partition_id().alias("part"))
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    words = texts.mapInArrow(_word_batches(tokenizer), "word string, block long, place int")
    encoded = words.repartition(many, "word").sortWithinPartitions("word").mapInArrow(_encode_batches(tokenizer), _CODES_SQL)
    blocks = texts.mapInArrow(_code_batches(tokenizer), _CODES_SQL)
    rows = encoded.union(blocks).repartition(many, "block").sortWithinPartitions("block", F.col("docs").isNotNull())
    return rows.mapInArrow(_assemble(tokenizer), "doc_id long, ids binary, decoded string")


def op10_query(spark, sf_dir):
    out = word_bpe(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
