"""Whole evidence plans: reads of invented genomes, clipped as a local aligner clips them, to records."""

import random

import pytest

from helixframe.plans import evidence

READS = "sample string, contig string, start_0 long, minus boolean, seq string, cigar string, mapq int, read_id long"


def shotgun(rng, genome, n, length):
    """(start, minus, read) of so many reads of a genome, both strands; the sequence is as on the top strand."""
    for _ in range(n):
        start = rng.randint(0, len(genome) - length)
        yield start, rng.random() < 0.5, genome[start : start + length]


def local_alignments(rng, sample, contig, reference, genome, where, n=1500, length=50, mapq=lambda start, end: 40):
    """Reads of a genome placed by where(start, end), the pieces (read_start, ref_start, size) of the read: the longest is aligned, the rest clipped."""
    rows = []
    for i, (start, minus, seq) in enumerate(shotgun(rng, genome, n, length)):
        q, r, size = max(where(start, start + length), key=lambda p: p[2])
        cigar = (f"{q}S" if q else "") + f"{size}M" + (f"{length - q - size}S" if q + size < length else "")
        rows.append((sample, contig, r, minus, seq, cigar, mapq(r, r + size), i))
    return rows


def invented(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def listed(found, *kinds):
    return sorted((r.sample, r.kind, *r.fields) for r in found if not kinds or r.kind in kinds)


@pytest.fixture(scope="module")
def found(spark):
    """Sample a lacks 50 bases from 501 on; b has two changed bases at 201 and 202 and reads with N; c is like the reference."""
    reference = invented(42, 1500)
    reference = reference[:495] + "ACGTACGTAC" + reference[505:545] + "TGCATGCATG" + reference[555:]
    lost = reference[:500] + reference[550:]
    cut_at = lambda a, b: [(0, a, b - a)] if b <= 500 else [(0, a + 50, b - a)] if a >= 500 else [(0, a, 500 - a), (500 - a, 550, b - 500)]
    whole = lambda a, b: [(0, a, b - a)]
    new = "".join(next(x for x in "GT" if x != b) for b in reference[200:202])
    changed = reference[:200] + new + reference[202:]
    rng = random.Random(12345)
    rows = local_alignments(rng, "a", "ref", reference, lost, cut_at)
    rows += local_alignments(rng, "b", "ref", reference, changed, whole)
    rows += [(*r[:4], "N" * 50, *r[5:]) for r in local_alignments(rng, "b", "ref", reference, reference, whole, 200)]
    rows += local_alignments(rng, "c", "ref", reference, reference, whole)
    reads = spark.createDataFrame([(*r[:7], k) for k, r in enumerate(rows)], READS)
    out = evidence.records(reads, spark.createDataFrame([("ref", reference)], "seq_id string, seq string")).collect()
    return out, new


def test_deletion_from_reads(found):
    out, _ = found
    assert listed([r for r in out if r.sample == "a"], "DEL", "SNP", "SUB", "INS", "MOB") == [("a", "DEL", "ref", "501", "50")]
    inner = [r for r in out if r.sample == "a" and r.kind in ("JC", "MC")]
    missing = ("a", "MC", "ref", "500", "551", "0", "0")  # unique depth leaves out each read's outermost base
    assert listed(inner) == [("a", "JC", "ref", "500", "-1", "ref", "551", "1", "0"), missing]
    gone = next(r for r in out if r.kind == "DEL")
    assert sorted(gone.parent_ids) == sorted(r.id for r in inner) and gone.id == 1
    joined = next(r for r in inner if r.kind == "JC")
    assert int(joined.attrs["pd_plus_reads"]) > 0 and int(joined.attrs["pd_minus_reads"]) > 0


def test_adjacent_changes_and_reads_of_n(found):
    out, new = found
    assert listed([r for r in out if r.sample == "b"], "SNP", "SUB", "INS", "DEL", "MOB", "JC") == [("b", "SUB", "ref", "201", "2", new)]
    assert listed([r for r in out if r.sample == "c"], "SNP", "SUB", "INS", "DEL", "MOB", "JC") == []


def test_insertion_of_an_element_from_reads(spark):
    """Two copies of an element of 80 bases; a third is inserted at 601, with three bases of the target doubled."""
    element, plain = invented(45, 80), invented(46, 4000)
    reference = plain[:1000] + element + plain[1080:2500] + element + plain[2580:]
    at, dup = 600, 4
    genome = reference[: at + dup] + element + reference[at:]

    def where(a, b):
        """Pieces of [a, b) of the genome on the reference; the new copy's bases lie at the first copy."""
        out = []
        for low, high, target in ((0, at + dup, 0), (at + dup, at + dup + 80, 1000), (at + dup + 80, len(genome), at)):
            x, y = max(a, low), min(b, high)
            if x < y:
                out.append((x - a, target + x - low, y - x))
        return out

    inside = lambda r, end: 0 if (r >= 1000 and end <= 1080) or (r >= 2500 and end <= 2580) else 40
    rows = local_alignments(random.Random(7), "s", "ref", reference, genome, where, 4500, 60, inside)
    reads = spark.createDataFrame(rows, READS)
    contigs = spark.createDataFrame([("ref", reference)], "seq_id string, seq string")
    repeats = spark.createDataFrame([(0, "ref", 1001, 1080, 1, "IS_T"), (1, "ref", 2501, 2580, 1, "IS_T")], evidence.NO_REPEATS)
    out = evidence.records(reads, contigs, repeats).collect()
    mobs = [r for r in out if r.kind == "MOB"]
    assert [tuple(r.fields) for r in mobs] == [("ref", str(at + 1), "IS_T", "1", str(dup))], listed(out)
    assert len(mobs[0].parent_ids) == 2 and {r.kind for r in out if r.id in mobs[0].parent_ids} == {"JC"}
    assert not [r for r in out if r.kind in ("DEL", "SNP", "SUB", "INS")]


def test_nothing_from_nothing(spark):
    reads = spark.createDataFrame([], READS)
    assert evidence.records(reads, spark.createDataFrame([("ref", "ACGT")], "seq_id string, seq string")).count() == 0
