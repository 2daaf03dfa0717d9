"""Readers and writers on small files."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.sources import readers, writers

GENBANK = '''LOCUS       AB1  30 bp DNA
VERSION     AB1.2
FEATURES             Location/Qualifiers
     source          1..30
     gene            complement(<3..9)
                     /gene="thrA"
                     /locus_tag="b1"
     CDS             join(3..9,12..>15)
                     /gene="thrA"
                     /product="aspartate kinase
                     and more"
     mobile_element  20..25
                     /mobile_element="insertion sequence:IS1"
     repeat_region   26..27
ORIGIN
        1 acgtacgtac gtacgtacgt acgtacgtac
//
'''


@pytest.fixture
def put(tmp_path):
    def f(name, text):
        p = tmp_path / name
        p.write_text(text)
        return str(p)

    return f


def test_references(spark, put):
    fa, gb = put("a.fa", ">c1 first\nacgt\nAC\n\n>c2\nGG\n"), put("b.gb", GENBANK)
    assert {r.seq_id: r.seq for r in readers.read_reference(spark, [fa, gb]).collect()} == {"c1": "ACGTAC", "c2": "GG", "AB1.2": "ACGT" * 7 + "AC"}
    with pytest.raises(ValueError, match="c1"):
        readers.read_reference(spark, [fa, put("d.fa", ">c1\nA\n")])
    with pytest.raises(ValueError, match="neither"):
        readers.read_reference(spark, [put("e.txt", "hello")])
    lines = writers.fasta_lines(readers.read_fasta(spark, fa), 4).orderBy("seq_id").collect()
    assert [r.value for r in lines] == [">c1\nACGT\nAC", ">c2\nGG"]


def test_genbank_features(spark, put):
    gb = put("b.gb", GENBANK)
    got = [(r.start, r.end, r.strand, r.feature_type, r.locus_tag, r.gene_name, r["product"]) for r in readers.read_features(spark, gb).orderBy("ord").collect()]
    assert got == [(3, 9, -1, "gene", "b1", "thrA", None), (3, 15, 1, "CDS", None, "thrA", "aspartate kinase and more")]
    assert [(r.start, r.end, r.name) for r in readers.read_repeats(spark, gb).orderBy("ord").collect()] == [(20, 25, "IS1"), (26, 27, "repeat")]


def test_gd(spark, put):
    text = "#=GENOME_DIFF\t1.0\n# note\nSNP\t1\t5,6\tc\t10\tG\tb=2\ta=x=y\nJC\t2\t.\tc\t1\t1\td\t2\t-1\t0\n"
    rows = readers.read_gd(spark, put("x.gd", text)).orderBy("ord").collect()
    assert [(r.kind, r.id, r.parent_ids, r.fields, r.attrs) for r in rows] == [("SNP", 1, [5, 6], ["c", "10", "G"], {"b": "2", "a": "x=y"}), ("JC", 2, [], ["c", "1", "1", "d", "2", "-1", "0"], {})]
    lines = [r.value for r in writers.gd_lines(readers.read_gd(spark, put("x.gd", text))).orderBy("ord").collect()]
    assert lines == ["SNP\t1\t5,6\tc\t10\tG\ta=x=y\tb=2", "JC\t2\t.\tc\t1\t1\td\t2\t-1\t0"]
    with pytest.raises(Exception, match="malformed"):
        readers.read_gd(spark, put("y.gd", "DEL\t1\t.\tc\t10\n")).collect()


def test_sam_and_fastq(spark, put):
    sam = put("a.sam", "@HD\tVN:1\nr1\t0\tc\t3\t60\t2S4M1I2M\t*\t0\t0\tACGTACGTA\tIIIIIIIII\tAS:i:10\tXS:i:10\nr2\t16\tc\t1\t60\t4M\t*\t0\t0\tACGT\tIIII\tAS:i:10\tXS:i:9\nr2\t256\tc\t9\t0\t4M\t*\t0\t0\tACGT\tIIII\n")
    got = readers.read_sam(spark, sam).select("qname", "start_0", "minus", "mapq", readers.cigar_counts(F.col("cigar")).alias("c")).collect()
    assert [(r.qname, r.start_0, r.minus, r.mapq, r.c.match, r.c.ins, r.c.span, r.c.query) for r in got] == [("r1", 2, False, 0, 6, 1, 6, 7), ("r2", 0, True, 60, 4, 0, 4, 4)]
    fq = put("a.fq", "".join(f"@q{i}/1 x\nACGT\n+\n@III\n" for i in range(50)))
    reads = readers.read_fastq(spark, fq)
    assert sorted(r.qname for r in reads.collect()) == sorted(f"q{i}/1" for i in range(50))
    names = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    kept = readers.second_pass_reads(reads, names(["q1"]), names([f"q{i}" for i in range(48)]))
    assert {r.qname for r in kept.collect()} == {"q1/1", "q48/1", "q49/1"}
    with pytest.raises(Exception, match="broken"):
        readers.read_fastq(spark, put("b.fq", "@q\nACGT\n+\n")).collect()


def test_tables(spark, put):
    got = readers.read_intended(spark, put("i.tsv", "seq_id\tposition\tend\tref\talt\tgd_type\n#c\nc\t5\t9\t.\t.\tdel\n")).collect()
    assert [tuple(r) for r in got] == [("edit_1", "c", 5, 9, None, None, "del")]
    with pytest.raises(Exception, match="interval"):
        readers.read_intended(spark, put("j.tsv", "seq_id\tstart\tend\nc\t9\t5\n")).collect()
    m = readers.read_manifest(spark, put("m.tsv", "clone_id\tr1\tspacer\nk1\ta.fq\t.\nk2\tb.fq\tACG\n")).collect()
    assert [(r.clone_id, r.r1, r.spacer) for r in m] == [("k1", "a.fq", None), ("k2", "b.fq", "ACG")]
    for bad in ("clone_id\tr1\nk1\n", "clone_id\tr1\nk\ta\nk\tb\n", "clone\tr1\nk\ta\n"):
        with pytest.raises(ValueError):
            readers.read_manifest(spark, put("n.tsv", bad))
    v2 = readers.read_sites_v2(spark, put("v2.tsv", "GAGTCCGAGCAGAAGAAGAA\tchr1\t100\tGAGTCCGAGCAGAAGAAGAATGG\t+\t0\n")).first()
    assert (v2.start, v2.end, v2.strand, v2.mismatches, v2.bulge_type) == (101, 123, "+", 0, "none")
    half = readers.read_sites_half_open(spark, put("f.tsv", "contig\tstart\tstop\torientation\ttarget\tnumberOfMismatches\tDoench2016CFDScore\tHsu2013\nc\t500\t523\tFWD\tACGT\t2\t0.5\tNA\n")).first()
    assert (half.start, half.end, half.strand, half.score_cfd, half.score_hsu) == (501, 523, "+", 0.5, None)
    closed = readers.read_sites_closed(spark, put("c.tsv", "chr\tposition\tstop\ttarget\tmismatches\tbulge_type\tbulge_size\tstrand\nc\t2000\t2024\tACGT\t1\tDNA\t1\t-\n")).first()
    assert (closed.start, closed.end, closed.bulge_type, closed.bulge_size) == (2000, 2024, "dna", 1)
    t = readers.read_time(spark, put("t.txt", "\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02:03\n\tMaximum resident set size (kbytes): 42\n")).first()
    assert (t.seconds, t.peak_kb) == (3723.0, 42)
    assert [tuple(r) for r in readers.read_metrics(spark, put("k.tsv", "a\t1\tx\nnone\n")).collect()] == [("a", "1\tx")]


def test_writers(spark, tmp_path):
    r = spark.range(1).select(writers.exponent(F.lit(1e-5)), writers.exponent(F.lit(0.0)), writers.exponent(F.lit(123456.0))).first()
    assert tuple(r) == ("1.000e-5", "0.000e0", "1.235e5")
    from helixframe.sources import products

    refs = spark.createDataFrame([("c", "ACGTACGT")], "seq_id string, seq string")
    seen = spark.createDataFrame([("e1", "SUB", ["c", "2", "3", "TT"], "c", 2, 4), ("e2", "JC", ["c", "3", "1", "d", "9", "-1", "0"], "c", 3, 3), ("e3", "DEL", ["c", "7", "2"], "c", 7, 8)], "event_id string, kind string, fields array<string>, seq_id string, position long, end long")
    seen = seen.select("*", F.lit("structural").alias("class"), *(F.lit(None).cast(t).alias(c) for c, t in (("hypothesis", "string"), ("pam", "string"), ("mismatches", "int"), ("distance", "long"))))
    names, lines = writers.unintended(products.unintended_rows(seen, refs, "cas9"))
    assert names[-1] == "event_id" and len(names) == 14
    assert sorted(r.value for r in lines.collect()) == ["c\t2\t4\tSUB\tCGT\tTT\tstructural\tcas9\t\t\t\t\t\te1", "c\t3\t3\tJC\t.\t.\tstructural\tcas9\t\t\t\td\t9\te2", "c\t7\t8\tDEL\t.\t.\tstructural\tcas9\t\t\t\t\t\te3"]
    assert products.columns("post_edit_variants")[-1] == "event_id"
    told = spark.createDataFrame([(["RA", "MC"],), (None,)], "k array<string>").select(products.evidence_text(F.col("k")).alias("t")).collect()
    assert [r.t for r in told] == ["RA=1;MC=1;JC=NA", "RA=NA;MC=NA;JC=NA"]
    writers.publish(str(tmp_path / "out"), {"a.tsv": "x"})
    writers.publish(str(tmp_path / "out"), {"b.tsv": writers.rendered((names, lines))})
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["b.tsv"] and len(list(tmp_path.iterdir())) == 1
    text = writers.report("T", {"One": spark.range(3).withColumn("x", F.lit(None)), "Two": "words"}, 2)
    assert "## 1. One" in text and "The first 2 of 3 rows." in text and text.endswith("words\n")


def test_metadata(spark, put, tmp_path):
    """Metadata lines come back as they were, before the records; a file without a version gets one."""
    text = "#=GENOME_DIFF\t1.0\n#=AUTHOR  some one\n# a comment\n#=FLAG\nSNP\t1\t2\tc\t5\tA\tx=1\nRA\t2\t.\tc\t5\t0\tC\tA\n"
    path = put("m.gd", text)
    rows = readers.read_gd_metadata(spark, path).orderBy("ord").collect()
    assert [(r.key, r.value) for r in rows] == [("GENOME_DIFF", "1.0"), ("AUTHOR", "some one"), ("FLAG", "")]
    out = [r.value for r in writers.gd_text(readers.read_gd(spark, path), readers.read_gd_metadata(spark, path)).collect()]
    assert out == ["#=GENOME_DIFF\t1.0", "#=AUTHOR\tsome one", "#=FLAG", "SNP\t1\t2\tc\t5\tA\tx=1", "RA\t2\t.\tc\t5\t0\tC\tA"]
    bare = readers.read_gd_metadata(spark, put("n.gd", "#=CREATED\tnow\nSNP\t1\t.\tc\t5\tA\n")).orderBy("ord").collect()
    assert [(r.key, r.value) for r in bare] == [("GENOME_DIFF", "1.0"), ("CREATED", "now")]
    with pytest.raises(Exception, match="malformed record"):
        readers.read_gd(spark, put("o.gd", "SNP\tx\t.\tc\t5\tA\n")).collect()


def test_lines_over_splits(spark, put):
    """Files cut into splits of a few bytes: numbers of lines, records of sequences and reads as if read whole."""
    rng = random.Random(17)
    seqs = {f"c{i}": "".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 400))) for i in range(6)}
    fasta = "".join(f">{k} some words\n" + "".join(f"{v[i:i + 30]}\r\n" for i in range(0, len(v), 30)) for k, v in seqs.items())
    genbank = "".join(f"LOCUS       {k} 1 bp\nFEATURES             Location\n     CDS             1..3\n                     /locus_tag=\"t{k}\"\nORIGIN\n" + "".join(f"{i + 1:9} {v[i:i + 10].lower()} {v[i + 10:i + 20].lower()}\n" for i in range(0, len(v), 20)) + "//\n" for k, v in seqs.items())
    reads = [(f"r{i}", "ACGT" * rng.randrange(1, 9)) for i in range(90)]
    fastq = "".join(f"@{n}/1 x\n{s}\n+\n{'I' * len(s)}\n" for n, s in reads)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "96")
        path = put("s.fa", fasta)
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        assert [(r.n, r.value) for r in readers.numbered_lines(spark, path).orderBy("n").collect()] == list(enumerate(fasta.replace("\r", "").splitlines()))
        assert {r.seq_id: r.seq for r in readers.read_fasta(spark, path).collect()} == seqs
        gb = put("s.gb", genbank)
        assert {r.seq_id: r.seq for r in readers.read_genbank(spark, gb).collect()} == seqs
        assert sorted(r.locus_tag for r in readers.read_features(spark, gb).collect()) == sorted(f"t{k}" for k in seqs)
        assert sorted((r.qname, r.seq, r.qual) for r in readers.read_fastq(spark, put("s.fq", fastq)).collect()) == sorted((f"{n}/1", s, "I" * len(s)) for n, s in reads)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
