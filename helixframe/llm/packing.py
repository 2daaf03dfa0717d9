"""Lexical retrieval packing: a sharded BM25 index gives each seed document unused neighbours that fill its window."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import release, small_batches, written

#: Tokens of a window; the id that ends a document.
WINDOW, END_ID = 2048, 1
#: Tokens of one shard of the index: the bound of a task's memory. A longer document is a shard of its own.
SHARD_TOKENS = 1_000_000
#: BM25's constants, and how many neighbours are ranked at a time.
K1, B, RANKED = 1.2, 0.75, 64
#: Words and pieces whose ids a worker remembers; they are taken in when they come in a second batch (or seem to).
CACHE, SEEN = 300_000, 1 << 23
#: Signs that end a word and, by the file's pattern, are a piece of their own.
_ENDS = [".", ",", ";", ":", "!", "?"]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """A tokenizer file that drops white space, a batch of texts at a time: each distinct word is encoded once.

    Exact where the tokenizer's normaliser and splitter never join characters across white space; texts that may hold
    special tokens, or separators that only some count as white space, are encoded whole. Where the file folds case and
    splits by a pattern, Latin words are folded and split by Arrow, and only pieces that aren't remembered go to the
    tokenizer's model, all of a batch in one call.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.seen = bytearray(SEEN)
        spec = json.loads(self.tokenizer.to_str())
        self.split = self._splitter(spec)
        self.letters = {b: x for b, x in enumerate(_byte_letters()) if b != 32}
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = spec["model"].get("end_of_word_suffix") or None
        self.last = np.zeros(self.size, bool)  # ids that end a piece
        for token, k in self.tokenizer.get_vocab().items():
            self.last[k] = bool(suffix) and token.endswith(suffix)

    @staticmethod
    def _splitter(spec: dict):
        """The file's pattern of pieces, if it has the steps that this class does itself."""
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in before] != ["Split", "ByteLevel"]:
            return None
        if not before[0]["invert"] or before[0]["behavior"] != "Removed" or before[1]["use_regex"] or before[1]["add_prefix_space"]:
            return None
        return regex.compile(before[0]["pattern"]["Regex"])

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def modelled(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, by the tokenizer's model."""
        spelt = " ".join(pieces)
        if not (spelt.isascii() and spelt.isprintable()):
            spelt = spelt.encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.bare.encode(spelt, add_special_tokens=False).ids, np.int64)
        ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
        if len(ends) != len(pieces) or ends[-1] != len(ids):  # a model that doesn't mark the ends
            return [np.array([t.id for t in self.bare.model.tokenize(p)], self.dtype).tobytes() for p in spelt.split(" ")]
        flat, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        return [flat[a * width : b * width] for a, b in zip([0, *ends], ends)]

    def remembered(self, words: pa.Array, make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of distinct words; those of new ones are made, and remembered when they come again and there is room."""
        spelt = words.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, spelt))
        lack = [k for k, x in enumerate(ids) if x is None and spelt[k]]
        if lack:
            new = [spelt[k] for k in lack]
            known, seen, room = self.known, self.seen, len(self.known) < CACHE
            for k, w, x in zip(lack, new, make(new)):
                ids[k] = x
                if room:
                    at = hash(w) % SEEN
                    if seen[at]:
                        known[w] = x
                    else:
                        seen[at] = 1
        return [x or b"" for x in ids]

    def flat(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids in one array, and how many each word has."""
        return np.frombuffer(b"".join(ids), self.dtype), np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize

    def pieces(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of Latin words, one after the other, and the offsets of each word's."""
        low = pc.utf8_lower(words)
        alpha = pc.utf8_is_alpha(low).to_numpy(zero_copy_only=False)
        rest = low.filter(pa.array(~alpha))
        stem, end = pc.utf8_slice_codeunits(rest, 0, -1), pc.utf8_slice_codeunits(rest, -1)
        two = pc.and_(pc.utf8_is_alpha(stem), pc.is_in(end, pa.array(_ENDS))).to_numpy(zero_copy_only=False)
        odd = [self.split.findall(w) for w in rest.filter(pa.array(~two)).to_pylist()]
        n, kind = np.ones(len(words), np.int64), np.flatnonzero(~alpha)
        n[kind[two]], n[kind[~two]] = 2, [len(x) for x in odd]
        offsets = np.concatenate(([0], np.cumsum(n)))
        parts = [low.filter(pa.array(alpha)), stem.filter(pa.array(two)), end.filter(pa.array(two)), pa.array([p for x in odd for p in x], pa.string())]
        at = offsets[:-1][kind[~two]]
        places = [offsets[:-1][alpha], offsets[:-1][kind[two]], offsets[:-1][kind[two]] + 1, np.concatenate([np.arange(a, a + len(x)) for a, x in zip(at.tolist(), odd)] or [at])]
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(places)))), offsets

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """flat() of distinct words."""
        if self.split is None:
            return self.flat(self.remembered(words, self.whole))
        raw, bounds = _utf8(words)  # other: beyond U+023F, or U+0130, whose lower case is two characters
        high = np.flatnonzero((raw >= 0xC9) | (raw == 0xC4) & (np.append(raw[1:], 0) == 0xB0))
        other = np.zeros(len(words), bool)
        other[np.searchsorted(bounds, high, "right") - 1] = True
        pieces, offsets = self.pieces(words.filter(pa.array(~other)) if len(high) else words)
        pieces = pieces.dictionary_encode()
        flat, size = _gathered(*self.flat(self.remembered(pieces.dictionary, self.modelled)), pieces.indices.to_numpy(), offsets)
        if not len(high):
            return flat, size
        rest, lengths = self.flat(self.remembered(words.filter(pa.array(other)), self.whole))
        order = np.argsort(np.concatenate((np.flatnonzero(~other), np.flatnonzero(other))))
        return _gathered(np.concatenate((flat, rest)), np.concatenate((size, lengths)), order, np.arange(len(order) + 1))

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The texts' ids, as packed little-endian numbers; nulls are empty."""
        texts = texts.fill_null("")
        raw, bounds = _utf8(texts)  # odd: may hold special tokens, or separators that only some count as white space
        odd = np.flatnonzero((raw >= 0x1C) & (raw < 0x20) | (raw == ord("<")) & (np.append(raw[1:], 0) == ord("|")))
        odd = np.unique(np.searchsorted(bounds, odd, "right") - 1)
        lists = pc.utf8_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        flat, size = _gathered(*self.words(words.dictionary), words.indices.to_numpy(), lists.offsets.to_numpy())
        ends = np.concatenate(([0], np.cumsum(size))).tolist()
        out = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]
        for k in odd.tolist():
            out[k] = self.whole([texts[k].as_py()])[0]
        return out


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts, and where each begins and the last ends."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def _gathered(flat: np.ndarray, size: np.ndarray, which: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of `size` items, taken by number, in one array; and the items of each list of such numbers, by its offsets."""
    n = size[which]
    ends = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat((np.cumsum(size) - size)[which] - ends[:-1], n) + np.arange(ends[-1])
    return flat[at], np.diff(ends[offsets - offsets[0]])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that tasks share what it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _unpacked(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if width == 2 else "<u4")


def _terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a document, and how often each occurs."""
    s = np.sort(ids, kind="stable")
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[at], np.diff(np.append(at, len(s)))


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) to (doc_id, ids binary, width int, counts): each document's ids and the end id, as packed numbers of width bytes.

    Each task adds one row without ids, whose counts are its number of documents, of ids, and the documents with each id.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("width", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        width, end = e.dtype.itemsize, np.array([end_id], e.dtype).tobytes()
        df = np.zeros(max(end_id + 1, e.size), np.int64)
        docs = length = 0
        for batch in batches:
            doc_ids, texts = batch.columns
            out = [ids + end for ids in e.encode_all(texts)]
            for ids in out:
                terms, _ = _terms(_unpacked(ids, width))
                df[terms] += 1
                length += len(ids) // width
            docs += len(out)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(out, pa.binary()), pa.array([width] * len(out), pa.int32()), pa.nulls(len(out), pa.binary())], schema=arrow)
        if docs:
            counts = np.concatenate(([docs, length], df)).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([None], [None], [width], [counts]), arrow)], schema=arrow)
        release()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, width int, counts binary")


def statistics(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """Document frequency by id, number and mean length of all documents, from the rows of counts.

    Each task sums its own rows; what reaches the driver is bounded by the vocabulary.
    """
    arrow = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for counts in batch.column(0):
                x = np.frombuffer(counts.as_buffer(), "<i8")
                total = x + total if len(total) else x
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=arrow)

    rows = tokens.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    total = np.zeros(max(2, at.max(initial=0) + 1), np.int64)
    total[at] = n
    return total[2:], int(total[0]), float(total[1]) / max(1, int(total[0]))


class Shard:
    """A BM25 inverted index of some documents, and which of their ids are still to be packed."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.docs = docs
        self.start = np.zeros(len(docs), np.int64)
        self.left = np.array([len(d) for d in docs], np.int64)
        terms, counts = zip(*map(_terms, docs))
        sizes = [len(t) for t in terms]
        owner = np.repeat(np.arange(len(docs)), sizes)
        flat, tf = np.concatenate(terms), np.concatenate(counts)
        shared = np.bincount(flat, minlength=len(idf)) > 1  # a term of one document finds no other
        kept = shared[flat]
        flat, tf, owner = flat[kept], tf[kept], owner[kept]
        weight = idf[flat] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.left[owner] / max(1.0, mean)))
        self.query, self.bounds = flat.astype(np.int64), np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(docs)))))
        order = np.argsort(flat, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.lists = np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=len(idf)))))
        self.next = 0

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents by falling BM25 score for all the seed's terms, ties by position; the rest follow in order."""
        terms = self.query[self.bounds[seed] : self.bounds[seed + 1]]
        parts = list(zip(self.lists[terms].tolist(), self.lists[terms + 1].tolist()))
        if parts:
            score = np.bincount(np.concatenate([self.owner[a:b] for a, b in parts]), np.concatenate([self.weight[a:b] for a, b in parts]), len(self.left))
            score[self.left == 0] = 0
            ranked, at = 0, np.flatnonzero(score)
            while ranked < len(at):  # the best come first; more are ranked where they don't fill the window
                most = min(len(at), max(RANKED, 4 * ranked))
                least = np.partition(score[at], len(at) - most)[len(at) - most]
                best = at[score[at] >= least]
                best = best[np.argsort(-score[best], kind="stable")]
                yield from best[ranked:].tolist()
                ranked = len(best)
        while (k := self.first()) is not None:
            yield k

    def first(self) -> int | None:
        while self.next < len(self.left) and not self.left[self.next]:
            self.next += 1
        return self.next if self.next < len(self.left) else None

    def take(self, k: int, most: int) -> tuple[int, int, int]:
        """(document, start, length) of its next ids, at most so many."""
        n, at = int(min(most, self.left[k])), int(self.start[k])
        self.start[k] += n
        self.left[k] -= n
        return k, at, n


def windows(shard: Shard, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (document, start, length), all full but perhaps the last.

    A document with a window's ids left fills windows of its own; what is left seeds a window that its neighbours fill,
    the last of them cut where the window ends.
    """
    while (seed := shard.first()) is not None:
        while shard.left[seed] >= window:
            yield [shard.take(seed, window)]
        if not shard.left[seed]:
            continue
        out = [shard.take(seed, window)]
        space = window - out[0][2]
        for k in shard.neighbours(seed):
            if not space:
                break
            if shard.left[k]:
                out.append(shard.take(k, space))
                space -= out[-1][2]
        yield out


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, text) to pieces of documents in sequences of at most `window` ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with with_ids the ids as packed little-endian 32-bit numbers.
    Each id lies in one piece; sequences are full but for the last of a partition of the tokenized table. Null and
    empty texts are the end id alone; repeated rows are packed as often as they are given; other columns aren't read;
    an empty table gives an empty result. Shards are runs of the tokenized table, so no documents are shuffled and a
    source with a third of all rows makes no large task; document frequencies are of the whole table.
    """
    tokens, _ = written(tokenize(docs, path, end_id))
    df, n, mean = statistics(tokens)
    idf = tokens.sparkSession.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    types = [pa.int64()] * 7 + [pa.binary()] * with_ids
    arrow = pa.schema([(c.split()[0], t) for c, t in zip(schema.split(", "), types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, np.ndarray]] = []

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=arrow)

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            """Packs what is held; but for the last time, an unfilled window's documents wait for the next shard."""
            nonlocal sequence, held
            shard = Shard([x for _, x in held], idf.value, mean)
            rows = []
            for pieces in windows(shard, window):
                if not last and sum(p[2] for p in pieces) < window:
                    kept.extend((held[k], at, size) for k, at, size in pieces)
                    continue
                emit(rows, [(held[k], at, size) for k, at, size in pieces])
                if len(rows) >= 500:
                    yield batch_of(rows)
                    rows = []
            held = []
            if rows:
                yield batch_of(rows)

        def emit(rows: list, pieces: list) -> None:
            nonlocal sequence
            offset = 0
            for (doc_id, ids), at, size in pieces:
                part = ids[at : at + size]
                packed = part.astype("<u4").tobytes()
                row = (doc_id, at, size, zlib.crc32(packed), len(ids), sequence, offset)
                rows.append((*row, packed) if with_ids else row)
                offset += size
            sequence += 1

        kept: list = []
        size = 0
        for batch in batches:
            for doc_id, ids, width in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((doc_id, _unpacked(ids, width)))
                size += len(held[-1][1])
                if size >= SHARD_TOKENS:
                    yield from packed(False)
                    size = 0
        if held:
            yield from packed(not kept)
        rows: list = []
        pieces, space = [], window
        for doc, at, size in kept:  # the unfilled windows of the shards, joined
            while size:
                take = min(size, space)
                pieces.append((doc, at, take))
                at, size, space = at + take, size - take, space - take
                if not space:
                    emit(rows, pieces)
                    pieces, space = [], window
        if pieces:
            emit(rows, pieces)
        if rows:
            yield batch_of(rows)
        release()

    return small_batches(tokens).where("ids is not null").select("doc_id", "ids", "width").mapInArrow(run, schema)
