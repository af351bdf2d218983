"""BPE encoding and decoding through a table of distinct words.

A word is a stretch of text that starts at the text's start or at a single
space between two characters that aren't white space.  A byte-level
pre-tokenizer always splits there, so the ids of a text are those of its words
in turn.  One pass splits texts, block by block; a block sends its distinct
words, by hash, to the task that holds that part of the word table, and beside
them the places of all its words.  That task encodes each distinct word of the
corpus once and answers each block with the ids, in the order in which it named
its words; where the answers meet the places, ids are joined back by position.
What is shuffled is each block's distinct words, their ids and each position's
word number, compressed: no row per word occurrence.  Texts are read once, so
the rows may come in any order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import lean, with_fields

#: Bytes of text in a block; a longer text is cut at word starts into blocks of its own.
BLOCK = 8_000_000
#: zstd's level for what is shuffled.
LEVEL = 6
#: Distinct words that a task of the word table remembers before it starts anew.
MEMO = 400_000
#: Distinct words encoded as one text.
TOGETHER = 50
#: Words joined to their ids at once.
JOINED = 200_000
#: What Unicode counts as white space, as the pre-tokenizer does.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts in which some space isn't single: RE2, for Arrow.
_ODD = f"^ | $|{_SPACE} | {_SPACE}"
_START = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=2)
def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    if any(" " in a.content or a.lstrip or a.rstrip for a in t.get_added_tokens_decoder().values()):
        raise ValueError("an added token of this tokenizer reaches across words")
    return t


@lru_cache(maxsize=2)
def pieces(path: str) -> pa.BinaryArray:
    """The id-to-piece table: each id's bytes."""
    tok = load(path)
    special = {i for i, t in tok.get_added_tokens_decoder().items()}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    size = max(tok.get_vocab(with_added_tokens=True).values()) + 1
    made = []
    for i in range(size):
        s = tok.id_to_token(i) or ""
        made.append(s.encode() if i in special else bytes(byte_of[c] for c in s))
    return pa.array(made, pa.binary())


def words_of(text: str) -> list[str]:
    """The words of a text; joined, they are the text."""
    return _START.split(text) if text else []


def _parts(text: str, size: int) -> list[str]:
    """A long text cut at word starts into parts of about `size` characters."""
    out, at = [], 0
    while len(text) - at > size:
        m = _START.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


@lru_cache(maxsize=1)
def _zstd() -> pa.Codec:
    """Shuffled blobs are compressed harder than by default: disk is scarcer than CPU here."""
    return pa.Codec("zstd", compression_level=LEVEL)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Whole numbers as few bytes as they need, all first bytes, then all second ones and so on, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
        body = _zstd().compress(planes, asbytes=True)
        out.append(len(a).to_bytes(8, "little") + width.to_bytes(1, "little") + len(body).to_bytes(8, "little") + body)
    return b"".join(out)


def _expand(blob: bytes, at: int = 0, most: int = 1 << 30) -> tuple[list[np.ndarray], int]:
    """Up to `most` arrays from place `at` on, and where they end."""
    out: list[np.ndarray] = []
    while at < len(blob) and len(out) < most:
        n, width, size = int.from_bytes(blob[at : at + 8], "little"), blob[at + 8], int.from_bytes(blob[at + 9 : at + 17], "little")
        a = np.zeros((n, 8), np.uint8)
        if n:
            a[:, :width] = np.frombuffer(pa.decompress(blob[at + 17 : at + 17 + size], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
        out.append(a.view("<u8").ravel())
        at += 17 + size
    return out, at


def _bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string or binary array without nulls."""
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if a.buffers()[2] else np.empty(0, np.uint8)
    return off - off[0], data


def _array(kind: pa.DataType, offsets: np.ndarray, data: np.ndarray | bytes) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data)])


def _pack(words: pa.StringArray) -> bytes:
    off, data = _bytes_of(words)
    body = data.tobytes()
    return _squeeze(np.diff(off), np.array([len(body)])) + _zstd().compress(body, asbytes=True)


def _unpack(blob: bytes) -> pa.StringArray:
    (lens, size), at = _expand(blob, 0, 2)
    body = pa.decompress(blob[at:], decompressed_size=int(size[0]), codec="zstd") if size[0] else b""
    return _array(pa.string(), np.concatenate([[0], np.cumsum(lens.astype(np.int64))]), body)


def _hashes(words: pa.StringArray) -> np.ndarray:
    """A hash of each (non-empty) word's bytes."""
    off, data = _bytes_of(words)
    power = np.cumprod(np.full(256, 0x9E3779B1, np.uint32), dtype=np.uint32)
    out = np.empty(len(words), np.uint32)
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, min(lo + 50_000, int(np.searchsorted(off, off[lo] + 4_000_000))))
        hi = min(hi, len(words))
        begin = off[lo:hi] - off[lo]
        place = np.arange(off[hi] - off[lo], dtype=np.int32) - np.repeat(begin, np.diff(off[lo : hi + 1]))
        out[lo:hi] = np.add.reduceat((data[off[lo] : off[hi]].astype(np.uint32) + np.uint32(1)) * power[place & 255], begin, dtype=np.uint32)
        lo = hi
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    return out ^ (out >> np.uint32(13))


def _numbered(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Distinct words of texts, frequent ones first (a word may come twice among
    them), the words' places among them text by text, and words a text."""
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) & ~empty
    plain = np.flatnonzero(~odd & ~empty)
    lists = pc.split_pattern(texts.take(pa.array(plain)) if len(plain) < len(texts) else texts, " ")
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(int(at[0]), int(at[-1] - at[0]))
    at = at - at[0]
    held = flat.dictionary_encode()
    index = held.indices.to_numpy().astype(np.int32)
    first = flat.take(pa.array(at[:-1])).dictionary_encode()  # a text's first word has no space before it
    index[at[:-1]] = len(held.dictionary) + first.indices.to_numpy()
    kinds = [pc.binary_join_element_wise(pa.scalar(" "), held.dictionary, pa.scalar("")), first.dictionary]
    sizes = np.zeros(len(texts), np.int64)
    sizes[plain] = np.diff(at)
    del lists, flat, held
    if odd.any():
        where = np.flatnonzero(odd)
        of = [words_of(t) for t in texts.take(pa.array(where)).to_pylist()]
        more = pa.array(list(chain.from_iterable(of)), pa.string()).dictionary_encode()
        sizes[where] = list(map(len, of))
        ends = np.cumsum(sizes)
        is_odd = np.repeat(odd, sizes)
        both = np.empty(int(ends[-1]), np.int32)
        both[~is_odd] = index
        both[is_odd] = sum(map(len, kinds)) + more.indices.to_numpy()
        index = both
        kinds.append(more.dictionary)
    words = pa.concat_arrays([k.cast(pa.string()) for k in kinds])
    counts = np.bincount(index, minlength=len(words))
    order = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return words.take(pa.array(order)), rank[index], sizes


def _stamp(words: pa.StringArray) -> int:
    import zlib

    return zlib.crc32(_bytes_of(words)[1])


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.StringArray, int, bool]]:
    """(doc ids, texts, part, last) of blocks of about `size` bytes; a longer
    text comes alone, in parts numbered from 0, each but the last with last False."""
    ids: list[pa.Array] = []
    texts: list[pa.Array] = []
    held = 0
    for b in batches:
        text = pc.fill_null(b.column(1), "")
        reach = np.cumsum(pc.binary_length(text).to_numpy().astype(np.int64))
        lo = 0
        while lo < len(text):
            before = int(reach[lo - 1]) if lo else 0
            hi = min(len(text), int(np.searchsorted(reach, before + size - held)) + 1)
            if reach[hi - 1] - (reach[hi - 2] if hi > 1 else 0) > size:  # the last of them is a long one
                hi -= 1
            if hi > lo:
                ids.append(b.column(0).slice(lo, hi - lo))
                texts.append(text.slice(lo, hi - lo))
                held += int(reach[hi - 1]) - before
                lo = hi
            long_one = lo < len(text) and int(reach[lo]) - (int(reach[lo - 1]) if lo else 0) > size
            if texts and (held >= size or long_one):
                yield pa.concat_arrays(ids), pa.concat_arrays(texts), 0, True
                ids, texts, held = [], [], 0
            if long_one:
                parts = _parts(text[lo].as_py(), size)
                for k, p in enumerate(parts):
                    yield b.column(0).slice(lo, 1), pa.array([p], pa.string()), k, k == len(parts) - 1
                lo += 1
    if texts:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts), 0, True


def _encoded(tok, words: list[str], lengths: np.ndarray) -> list[bytes]:
    """The ids of each word.  Words that start at a space and end in no white
    space are encoded TOGETHER at a time, for speed: the tokenizer splits
    between them, and pieces' lengths say where each word's ids end."""
    out: list[bytes | None] = [None] * len(words)
    glued = [i for i, w in enumerate(words) if w[0] == " " and len(w) > 1 and not w[1].isspace() and not w[-1].isspace()]
    for at in range(0, len(glued), 400 * TOGETHER):
        some = glued[at : at + 400 * TOGETHER]
        texts = ["".join([words[i] for i in some[k : k + TOGETHER]]) for k in range(0, len(some), TOGETHER)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in tok.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.cumsum(lengths[ids])
        stops = np.cumsum([len(words[i].encode()) for i in some])
        place = np.searchsorted(ends, stops)
        if (ends[np.minimum(place, len(ends) - 1)] != stops).any():
            raise ValueError("this tokenizer's pieces don't end where words do")
        body, cuts = ids.tobytes(), np.concatenate([[0], 4 * (place + 1)]).tolist()
        for i, a, z in zip(some, cuts, cuts[1:], strict=False):
            out[i] = body[a:z]
    rest = [i for i, x in enumerate(out) if x is None]
    for at in range(0, len(rest), 20_000):
        some = rest[at : at + 20_000]
        for i, e in zip(some, tok.encode_batch_fast([words[i] for i in some], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
    return out


SHAPE = "chain long, block long, part int, home int, stamp long, blob binary"
_NAMES = [f.split()[0] for f in SHAPE.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES, strict=True)], names=_NAMES)


def encode(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None, decoded: bool = False, block: int = BLOCK) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) and n_tokens of each row.

    Ids are those of encode(text, add_special_tokens=False).  A null or empty
    text has no ids; a row with a null doc_id stays; repeated rows each get a
    row.  decoded: also the text that decode() makes of the ids, in the same
    task.  Other columns are not read; an empty table gives an empty table.
    buckets: parts of the word table, by default the session's shuffle
    partitions.  A task holds a block of texts (about `block` bytes; a longer
    text is cut at word starts, and only its ids are whole), or MEMO distinct
    words of its part of the table.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[doc_id].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for ids, texts, part, last in _blocks(batches, block):
            number += 1
            head = pa.RecordBatch.from_arrays([ids.cast(id_type)], names=["doc_id"]).serialize().to_pybytes()
            words, places, sizes = _numbered(texts)
            del texts
            stamp = _stamp(words)
            home = (_hashes(words) % np.uint32(n)).astype(np.int64) if len(words) else np.empty(0, np.int64)
            order = np.argsort(home, kind="stable")
            ends = np.cumsum(np.bincount(home, minlength=n))
            words = words.take(pa.array(order))
            for k in np.flatnonzero(np.diff(ends, prepend=0)):
                lo = int(ends[k - 1]) if k else 0
                yield _row(number - part, number, k, k, stamp, _pack(words.slice(lo, int(ends[k]) - lo)))
            # a word's number: its place in its bucket x n + bucket, small for frequent words
            of = np.empty(len(words), np.int64)
            of[order] = (np.arange(len(words)) - np.concatenate([[0], ends])[home[order]]) * n + home[order]
            body = len(head).to_bytes(8, "little") + bytes([last]) + head + _squeeze(np.array([len(words)]), sizes, of[places] if len(places) else places)
            del words, places
            yield _row(number - part, number, n, number % n, stamp, body)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, lengths = load(tokenizer_path), np.diff(_bytes_of(pieces(tokenizer_path))[0])
        memo: dict[str, bytes] = {}

        def made(keys: list, lists: list[pa.StringArray]) -> pa.RecordBatch:
            words = pa.concat_arrays(lists).dictionary_encode()
            distinct = words.dictionary.to_pylist()
            new = [w for w in distinct if w not in memo]
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = distinct
            memo.update(zip(new, _encoded(tok, new, lengths), strict=True))
            off, data = _bytes_of(pa.array([memo[w] for w in distinct], pa.binary()).take(words.indices))
            blobs, at = [], 0
            for x in lists:
                own = off[at : at + len(x) + 1]
                blobs.append(_squeeze(np.diff(own) // 4, np.frombuffer(data[own[0] : own[-1]].tobytes(), "<u4")))
                at += len(x)
            columns = [pa.array(c, t) for c, t in zip(zip(*keys, strict=True), _TYPES[:5], strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary())], names=_NAMES)

        keys, lists, size = [], [], 0
        for b in batches:
            part = b.column(2).to_numpy()
            carried = np.flatnonzero(part == n)
            if len(carried):
                yield b.take(pa.array(carried))
            for i in np.flatnonzero(part < n):
                keys.append(tuple(b.column(c)[i].as_py() for c in range(5)))
                lists.append(_unpack(b.column(5)[i].as_py()))
                size += len(lists[-1])
                if size >= JOINED:
                    yield made(keys, lists)
                    keys, lists, size = [], [], 0
        if keys:
            yield made(keys, lists)

    names = ["doc_id", "ids", "n_tokens", *["decoded"] * decoded]

    def out(keys: pa.Array, offsets: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        ids = _array(pa.binary(), offsets, data)
        columns = [keys, ids, pa.array(np.diff(offsets) // 4, pa.int64())]
        if decoded:
            columns.append(_decoded(ids, tokenizer_path))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        of, begun = None, []
        for b in batches:
            for i in range(b.num_rows):
                number, k, stamp, blob = (b.column(c)[i].as_py() for c in (1, 2, 4, 5))
                if number != of:
                    of, answers = number, {}
                if k < n:
                    answers[k] = (stamp, *_expand(blob)[0])
                    continue
                size, last = int.from_bytes(blob[:8], "little"), bool(blob[8])
                keys = pa.ipc.read_record_batch(pa.py_buffer(blob[9 : 9 + size]), pa.schema([("doc_id", id_type)])).column(0)
                (told, sizes, places), _ = _expand(blob, 9 + size)
                del blob
                counts = np.array([len(answers[j][1]) if j in answers else 0 for j in range(n)])
                if counts.sum() != told[0] or any(a[0] != stamp for a in answers.values()):
                    raise RuntimeError("a lost block came back with other rows: write the texts to a table first")
                have = [answers[j] for j in sorted(answers)]
                lens = np.concatenate([a[1] for a in have]) if have else np.empty(0, np.uint64)
                table = _array(pa.binary(), np.concatenate([[0], np.cumsum(4 * lens.astype(np.int64))]), np.concatenate([a[2] for a in have]).astype("<u4").view(np.uint8) if have else b"")
                answers, have = {}, []
                first = np.cumsum(counts) - counts
                ends = np.cumsum(sizes.astype(np.int64))
                lo = 0
                while lo < len(keys):
                    start = int(ends[lo - 1]) if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(ends, start + JOINED, "right")))
                    where = places[start : ends[hi - 1]].astype(np.int64)
                    off, data = _bytes_of(table.take(pa.array(first[where % n] + where // n)))
                    if begun or not last:
                        begun.append(data)
                        if last:
                            data = np.concatenate(begun)
                            begun = []
                            yield out(keys, np.array([0, len(data)]), data)
                    else:
                        yield out(keys.slice(lo, hi - lo), off[np.concatenate([[start], ends[lo:hi]]) - start], data)
                    lo = hi

    met = rows.mapInArrow(lean(split), SHAPE).repartition(n, "home").mapInArrow(lean(answer), SHAPE)
    met = met.repartition(n, "chain").sortWithinPartitions("chain", "block", "part")
    return met.mapInArrow(lean(join), T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), *[T.StructField("decoded", T.StringType())] * decoded]))


def _decoded(ids: pa.Array, path: str) -> pa.StringArray:
    """Each id joined to its piece; the pieces' bytes in turn as text."""
    off, data = _bytes_of(ids)
    if len(off) == 1:
        return pa.array([], pa.string())
    at, text = _bytes_of(pieces(path).take(pa.array(np.frombuffer(data.tobytes(), "<u4"))))
    made = _array(pa.string(), at[off // 4], text)
    try:
        made.validate(full=True)
    except pa.ArrowInvalid:  # some ids are parts of characters
        body, at = text.tobytes(), at[off // 4]
        made = pa.array([body[a:z].decode("utf-8", "replace") for a, z in zip(at[:-1], at[1:], strict=True)], pa.string())
    return made


def decode(encoded: DataFrame, tokenizer_path: str, *, ids: str = "ids") -> DataFrame:
    """encoded with decoded, the text of decode(ids, skip_special_tokens=False).

    Each id is joined to its piece in a table as large as the vocabulary; the
    pieces' bytes in turn are the text (bytes that aren't UTF-8 become U+FFFD).
    Null or no ids: an empty text.  An id outside the table is an error.
    """

    def fn(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for t in tables:
            yield pa.table({"decoded": _decoded(pc.fill_null(t.column("ids").combine_chunks().cast(pa.binary()), b""), tokenizer_path)})

    return with_fields(encoded, fn, {"ids": ids}, [("decoded", T.StringType())])
