"""Guide-site search in sequences: mismatches and bulges next to a PAM, on both strands; exact places of many strings.

Sequences reach the workers as bytes, in pieces, and each piece is one pass of array operations: positions with a PAM are
found first and only those are compared with the guide; strings are found by rolling hashes of all their places at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequence
from helixframe.plans.session import cut

#: Bases of a piece of a contig; pieces overlap by what a site needs.
PIECE = 1 << 20
#: Distinct seeds that are sent to the workers, 8 bytes each; with more, every place meets the seeds in a join instead.
SENT_SEEDS = 4_000_000
#: Rows of a batch that goes back.
ROWS = 1 << 16


@dataclass(frozen=True)
class Nuclease:
    """What a guide's nuclease needs beside it: a pattern of IUPAC codes, after (3) or before (5) the protospacer."""

    name: str
    pam: str
    side: int = 3


CAS9, CAS12A = Nuclease("SpCas9", "NGG", 3), Nuclease("Cas12a", "TTTV", 5)

_BYTES = np.arange(256, dtype=np.uint8)
_UPPER = np.where((_BYTES >= 97) & (_BYTES <= 122), _BYTES - 32, _BYTES).astype(np.uint8)
#: The base of a letter as one bit; U is T, others none.
_BIT = np.zeros(256, np.uint8)
_TURNED = _UPPER.copy()
for _i, (_letters, _pair) in enumerate((("Aa", "T"), ("Cc", "G"), ("Gg", "C"), ("TtUu", "A"))):
    for _c in _letters:
        _BIT[ord(_c)], _TURNED[ord(_c)] = 1 << _i, ord(_pair)


def _bits(pattern: str) -> list[int]:
    """The bases that each IUPAC code stands for, as bits."""
    return [int(sum(_BIT[ord(b)] for b in sequence.IUPAC[c])) for c in pattern.upper()]


def pieces(contigs: DataFrame, overlap: int, piece: int = PIECE) -> DataFrame:
    """(seq_id, off, data): contigs as bytes, cut every `piece` letters, each piece with `overlap` letters more.

    Bytes are cut without walking along them, as characters must be; letters beyond ASCII are `?` first. Where the input
    has fewer partitions than the cluster has cores, the pieces are dealt out; else they stay where they are.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.char_length("seq") - 1, F.lit(0)).cast("long"), F.lit(piece).cast("long"))
    rows = contigs.select("seq_id", "seq").where(F.col("seq").isNotNull()).select("seq_id", "seq", F.explode(starts).alias("off"))
    plain = F.when(F.octet_length("seq") == F.char_length("seq"), F.col("seq")).otherwise(F.regexp_replace("seq", r"[^\x00-\x7F]", "?")).cast("binary")
    parts = rows.select("seq_id", "off", F.substring(plain, (F.col("off") + 1).cast("int"), F.lit(piece + overlap)).alias("data"))
    cores = contigs.sparkSession.sparkContext.defaultParallelism
    return parts.repartition(4 * cores, "seq_id", "off") if contigs.rdd.getNumPartitions() < cores else parts


def _map_pieces(rows: DataFrame, make: Callable[[np.ndarray], Iterator[list[pa.Array]]], schema: str, piece: int) -> DataFrame:
    """Applies make to each piece's bytes; it yields columns, whose first is a 0-based place in the piece's own part.

    The result has seq_id, start (1-based in the contig) and the other columns, as in `schema`.
    """
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq_id, off, data in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                for at, *others in make(np.frombuffer(data.as_buffer(), np.uint8) if data.is_valid else np.zeros(0, np.uint8)):
                    own = np.flatnonzero(at < piece)
                    for i in range(0, len(own), ROWS):
                        take = pa.array(own[i : i + ROWS])
                        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(seq_id.as_py(), pa.string()), len(take)), pa.array(at[own[i : i + ROWS]] + (off + 1)), *(c.take(take) for c in others)], names)

    return rows.mapInArrow(run, schema)


def _strings(data: np.ndarray, at: np.ndarray, length: int, turn: bool = False) -> pa.Array:
    """Substrings of a length at some places, upper case, or their reverse complements."""
    found = (_TURNED if turn else _UPPER)[data[at[:, None] + (np.arange(length)[::-1] if turn else np.arange(length))]]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.arange(0, (len(at) + 1) * length, length or 1, dtype=np.int32)[: len(at) + 1]), pa.py_buffer(found.tobytes()))


def windows(contigs: DataFrame, length: int, piece: int = PIECE) -> DataFrame:
    """(seq_id, start, window): every substring of a length, upper case, 1-based starts."""

    def make(data):
        for i in range(0, len(data) - length + 1, ROWS):
            at = np.arange(i, min(i + ROWS, len(data) - length + 1))
            yield at, _strings(data, at, length)

    return _map_pieces(pieces(contigs, length - 1, piece), make, "seq_id string, start long, window string", piece)


def _layout(nuclease: Nuclease, n: int, minus: bool) -> tuple[int, int, str]:
    """0-based places of protospacer and PAM in a window, and the PAM as the top strand reads it."""
    k = len(nuclease.pam)
    pam = sequence.reverse_complement_iupac(nuclease.pam) if minus else nuclease.pam
    return (0, n, pam) if (nuclease.side == 3) != minus else (k, 0, pam)


def _motif(bits: np.ndarray, offset: int, pattern: str, windows: int) -> np.ndarray:
    """Starts of windows with the pattern at an offset; the most telling letter is looked for first."""
    codes = sorted(enumerate(_bits(pattern)), key=lambda x: x[1].bit_count())
    at = None
    for i, code in codes:
        here = bits[offset + i : offset + i + windows] if at is None else bits[at + (offset + i)]
        fits = np.flatnonzero(here & code)
        at = fits if at is None else at[fits]
    return np.arange(windows) if at is None else at


def _wrong(bits: np.ndarray, at: np.ndarray, guide: list[int]) -> np.ndarray:
    """Mismatches of a guide's bits at each place."""
    return sum(((bits[at + i] & code == 0).astype(np.int32) for i, code in enumerate(guide)), np.zeros(len(at), np.int32))


def _bulged(bits: np.ndarray, at: np.ndarray, guide: list[int], bulge: int) -> np.ndarray:
    """Least mismatches of a guide at each place, with `bulge` extra (positive) or missing (negative) bases of the target.

    Extra bases of the target (a DNA bulge) or unpaired bases of the guide (an RNA bulge) lie together, not at an end.
    What is before the bulge is compared as it stands, what is behind it moved by the bulge; the best place counts.
    """
    n, drop = len(guide), max(-bulge, 0)
    inner = range(1, n - drop)
    if not inner:
        return np.full(len(at), n, np.int32)
    straight = np.stack([bits[at + i] & guide[i] == 0 for i in range(n - drop)])
    moved = np.stack([bits[at + i + bulge] & guide[i] == 0 for i in range(1 + drop, n)])
    before = np.cumsum(straight, 0, dtype=np.int32)
    behind = np.cumsum(moved[::-1], 0, dtype=np.int32)[::-1]
    return (before[[c - 1 for c in inner]] + behind[[c - 1 for c in inner]]).min(0)


def _sites(contigs: DataFrame, guide: str, nuclease: Nuclease, most: int, kinds: list[tuple[str, int, int]], piece: int) -> DataFrame:
    """Sites of each kind (name, size, bulge), all in one pass over the contigs."""
    guide = guide.upper().replace("U", "T")
    k = len(nuclease.pam)

    def make(data):
        bits = _BIT[data]
        for name, bulged, bulge in kinds:
            n = len(guide) + bulge
            for minus in (False, True):
                proto, pam, pattern = _layout(nuclease, n, minus)
                codes = _bits(guide.translate(sequence.COMPLEMENT)[::-1] if minus else guide)
                found = _motif(bits, pam, pattern, max(0, len(data) - n - k + 1))
                for i in range(0, len(found), ROWS):
                    at = found[i : i + ROWS]
                    wrong = _bulged(bits, at + proto, codes, bulge) if bulge else _wrong(bits, at + proto, codes)
                    at, wrong = at[wrong <= most], wrong[wrong <= most]
                    every = lambda x, t=pa.string(), m=len(at): pa.repeat(pa.scalar(x, t), m)
                    yield at, every(n + k, pa.int64()), every("-" if minus else "+"), _strings(data, at + proto, n, minus), _strings(data, at + pam, k, minus), pa.array(wrong), every(name), every(bulged, pa.int32())

    longest = max(len(guide) + bulge + k for _, _, bulge in kinds)
    found = _map_pieces(pieces(contigs, longest - 1, piece), make, "seq_id string, start long, `end` long, strand string, target string, pam string, mismatches int, bulge_type string, bulge_size int", piece)
    return found.withColumn("end", F.col("start") + F.col("end") - 1)


def fitting(contigs: DataFrame, length: int, pattern: str, piece: int = PIECE) -> DataFrame:
    """(seq_id, windows, fits): how many substrings of a length each contig has, and how many begin with a pattern of IUPAC codes.

    They are counted where they lie, without a row for each; contigs shorter than the length don't appear.
    """

    def make(data):
        n = min(len(data) - length + 1, piece)
        if n > 0:
            yield np.zeros(1, np.int64), pa.array([n], pa.int64()), pa.array([len(_motif(_BIT[data], 0, pattern, n))], pa.int64())

    found = _map_pieces(pieces(contigs, length - 1, piece), make, "seq_id string, start long, windows long, fits long", piece)
    return found.groupBy("seq_id").agg(F.sum("windows").alias("windows"), F.sum("fits").alias("fits"))


def scan(contigs: DataFrame, guide: str, nuclease: Nuclease = CAS9, most: int = 4, piece: int = PIECE) -> DataFrame:
    """Sites with at most so many mismatches and a fitting PAM.

    Returns seq_id, start, end (1-based, protospacer and PAM), strand, target and pam as the guide reads them,
    mismatches. The reverse strand is the same search of the top strand with guide and PAM turned around. Letters other
    than A, C, G, T mismatch; U is T. Null sequences have no sites.
    """
    return _sites(contigs, guide, nuclease, most, [("none", 0, 0)], piece).drop("bulge_type", "bulge_size")


def scan_bulges(contigs: DataFrame, guide: str, nuclease: Nuclease = CAS9, most: int = 4, dna: int = 1, rna: int = 1, piece: int = PIECE) -> DataFrame:
    """scan() and, for bulges up to the given sizes, sites with one bulge: adds bulge_type (none, DNA, RNA) and bulge_size.

    Sites with and without a bulge are listed side by side, as their spans differ.
    """
    kinds = [("none", 0, 0), *(("DNA", k, k) for k in range(1, dna + 1)), *(("RNA", k, -k) for k in range(1, rna + 1))]
    return _sites(contigs, guide, nuclease, most, kinds, piece)


def rolled(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k letters from each place on: hashes of half as many letters, put together, as often as needed."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    done, out, power, width = 0, np.zeros(len(data), np.uint64), np.full(1, 0x9E3779B97F4A7C15, np.uint64), 1
    part = data.astype(np.uint64) + np.uint64(1)
    while k:
        if k & 1:
            m = len(data) - done - width + 1
            out = out[:m] * power + part[done : done + m]
            done += width
        k >>= 1
        if k:
            part = part[:-width] * power + part[width:]
            power, width = power * power, width * 2
    return out


def _spread(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)


def kmer_placements(queries: DataFrame, contigs: DataFrame, k: int = 12, piece: int = PIECE) -> DataFrame:
    """Exact places of query strings in contigs: (query, seq_id, start, minus), 1-based.

    Distinct queries of at least k letters and their reverse complements are found by a hash of their first k letters.
    Up to SENT_SEEDS of these, as counted, go to the workers, where a table of bits and a sorted array pass only places
    with such a hash; these meet the queries in an equi join and are compared in full. With more seeds, all places do.
    """
    spark = contigs.sparkSession
    distinct = cut(queries.select("query").where(F.length("query") >= k).distinct())  # read four times below
    both = distinct.select("query", F.lit(False).alias("minus"), F.col("query").alias("q")).union(distinct.select("query", F.lit(True), sequence.reverse_complement("query")))

    def hashed(batches):
        for batch in batches:
            heads = [np.frombuffer(q.encode("ascii", "replace")[:k], np.uint8) for q in batch.column(2).to_pylist()]
            keys = rolled(np.concatenate(heads), k)[::k] if heads else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], ["query", "minus", "q", "seed"])

    seeds = both.mapInArrow(hashed, "query string, minus boolean, q string, seed long")
    longest, n = distinct.agg(F.coalesce(F.max(F.length("query")), F.lit(k)), F.count("*")).first()
    sent = None
    if 2 * n <= SENT_SEEDS:
        some = np.unique(seeds.select("seed").toArrow().column(0).to_numpy().view(np.uint64))
        table = np.zeros(1 << 24, np.bool_)
        table[_spread(some)] = True
        sent = spark.sparkContext.broadcast((some, np.packbits(table)))

    def make(data):
        hashes = rolled(data, k)
        at = np.arange(len(hashes))
        if sent is not None:
            some, table = sent.value
            slot = _spread(hashes)
            at = np.flatnonzero(table[slot >> np.uint64(3)] >> (7 - (slot & np.uint64(7)).astype(np.uint8)) & 1)
            if len(some):
                found = np.minimum(np.searchsorted(some, hashes[at]), len(some) - 1)
                at = at[some[found] == hashes[at]]
        for i in range(0, len(at), ROWS):
            part = at[i : i + ROWS]
            text = data.tobytes() if i == 0 else text
            yield part, pa.array(hashes[part].view(np.int64)), pa.array([text[a : a + longest].decode("ascii") for a in part.tolist()], pa.string())

    places = _map_pieces(pieces(contigs, longest - 1, piece), make, "seq_id string, start long, seed long, text string", piece)
    return seeds.join(places, "seed").where(F.startswith("text", "q")).select("query", "seq_id", "start", "minus")
