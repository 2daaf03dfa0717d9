"""Intended edits, the composed audit, cohorts and streams."""

import random

from pyspark.sql import functions as F

from helixframe.functions import identity
from helixframe.operators import intended, sites
from helixframe.plans import audit
from helixframe.streaming import recurrence

EVENTS = "event_id string, kind string, fields array<string>"
EDITS = "edit_id string, seq_id string, start long, end long, ref string, alt string, kind string"
SNP, JC, DEL, INS = (lambda i, p, b: (i, "SNP", ["c", str(p), b])), (lambda i, a, b: (i, "JC", ["c", str(a), "-1", "c", str(b), "1", "0"])), (lambda i, p, n: (i, "DEL", ["c", str(p), str(n)])), (lambda i, p, b: (i, "INS", ["c", str(p), b]))


CASES = [
    ((10, 10, "T", "snp"), [SNP("a", 10, "t")], "complete", ["a"], []),
    ((10, 10, "T", "snp"), [SNP("a", 10, "G")], "partial", ["a"], []),
    ((10, 10, "T", "snp"), [SNP("a", 10, "T"), JC("b", 10, 90)], "unexpected_structure", ["a"], ["b"]),
    ((10, 10, "T", "snp"), [SNP("a", 10, "T"), INS("b", 10, "A")], "partial", ["a"], ["b"]),
    ((10, 10, "T", "snp"), [INS("b", 10, "A")], "missing", [], ["b"]),
    ((10, 10, "T", "snp"), [SNP("a", 11, "T")], "missing", [], []),
    ((100, 149, ".", "del"), [DEL("a", 100, 50)], "complete", ["a"], []),
    ((100, 149, ".", "del"), [DEL("a", 101, 50)], "complete", ["a"], []),
    ((100, 149, ".", "del"), [DEL("a", 103, 50)], "partial", ["a"], []),
    ((100, 149, ".", "del"), [DEL("a", 100, 50), SNP("b", 120, "A")], "unexpected_structure", ["a"], ["b"]),
    ((100, 149, ".", "del"), [JC("j", 98, 149)], "complete", ["j"], []),
    ((100, 149, ".", "del"), [JC("j", 120, 149)], "unexpected_structure", [], ["j"]),
    ((100, 149, ".", "cassette"), [JC("j", 98, 900), JC("k", 800, 150)], "complete", ["j", "k"], []),
    ((100, 149, ".", "cassette"), [JC("j", 98, 900)], "partial", ["j"], []),
    ((100, 149, ".", "cassette"), [], "missing", [], []),
]


def test_assessment(spark):
    """Every case on a sequence of its own, judged in one plan."""
    moved = lambda k, fields: [f"c{k}" if x == "c" else x for x in fields]
    edits = spark.createDataFrame([(f"e{k}", f"c{k}", e[0], e[1], None, e[2], e[3]) for k, (e, *_) in enumerate(CASES)], EDITS)
    events = spark.createDataFrame([(f"{k}{i}", kind, moved(k, fields)) for k, c in enumerate(CASES) for i, kind, fields in c[1]], EVENTS)
    got = {r.edit_id: r for r in intended.assess(edits, events).collect()}
    for k, (_, _, status, matched, unexpected) in enumerate(CASES):
        r = got[f"e{k}"]
        assert (r.status, list(r.matched), list(r.unexpected)) == (status, [f"{k}{i}" for i in matched], [f"{k}{i}" for i in unexpected]), k


def test_audit(spark):
    guide = "GACTGACTGACTGACTGACT"
    seq = "ACGTTGCATCA" * 30 + guide + "TGG" + "TTGACCATGAC" * 30
    refs = spark.createDataFrame([("c", seq)], "seq_id string, seq string")
    records = lambda rows: spark.createDataFrame(rows, "id int, kind string, fields array<string>")
    at = len("ACGTTGCATCA" * 30)
    starter = records([(1, "SNP", ["c", "5", "A"]), (9, "RA", ["c", "1", "0", "A", "C"])])
    edited = records([(1, "SNP", ["c", "5", "A"]), (2, "SNP", ["c", "50", "G"]), (3, "SNP", ["c", str(at + 30), "C"]), (4, "DEL", ["c", "600", "40"]), (5, "SNP", ["c", "120", "T"])])
    edits = spark.createDataFrame([("e1", "c", 50, 50, None, "G", "snp")], EDITS)
    a = audit.audit(edited, starter, refs, edits, guide, hypothesis=True)
    got = {tuple(r.fields)[1]: (r["class"], r.hypothesis) for r in a.unintended.collect()}
    assert got == {str(at + 30): ("near_homolog", None), "600": ("structural", None), "120": ("scattered_snv", "sos_widney2014")}
    assert {r.key: r.value for r in a.summary().collect()} == {"events": 4, "class_near_homolog": 1, "class_structural": 1, "class_scattered_snv": 1, "intended_complete": 1}
    assert "SITE_000001" in a.report() and "e1" in a.report()


def test_clones_as_alone(spark):
    """Many clones in one plan: each has the events, assessments, sites and classes of an audit of its own."""
    rng = random.Random(23)
    guide = "GACTGACTGACTGACTGACT"
    seq = "".join(rng.choice("ACGT") for _ in range(900)) + guide + "TGG" + "".join(rng.choice("ACGT") for _ in range(900))
    refs = spark.createDataFrame([("c", seq), ("d", seq[::-1])], "seq_id string, seq string")

    def drawn(k: int) -> list[tuple]:
        out = []
        for i in range(k):
            p, c = rng.choice((100, 400, 930, 1500)) + rng.randrange(4), rng.choice("cd")
            out.append(rng.choice([(i, "SNP", [c, str(p), "A"]), (i, "DEL", [c, str(p), str(rng.choice((1, 40, 41)))]), (i, "JC", ["c", str(p), "1", "d", str(p + 300 + rng.randrange(3)), "-1", "0"]), (i, "MOB", [c, str(p), "IS1", "1", "9"])]))
        return out

    kinds = "id int, kind string, fields array<string>"
    starter = spark.createDataFrame(drawn(25), kinds)
    clones = {name: drawn(n) for name, n in (("k1", 30), ("k2", 45), ("k3", 0), ("k.4", 12))}
    clones["twin"] = clones["k1"]
    edits = {"k1": [("e1", "c", 100, 103, None, "A", "snp"), ("e2", "c", 400, 440, None, ".", "del")], "k2": [("e1", "d", 930, 931, None, ".", "cassette")], "k3": [("e9", "c", 5, 5, None, "A", "snp")]}
    guides = {"k1": (guide, "NGG"), "k2": (guide, "NGG"), "k.4": (guide, "NRG")}
    everything = spark.createDataFrame([(c, *r) for c, rows in clones.items() for r in rows], f"clone_id string, {kinds}")
    wanted = spark.createDataFrame([(c, *e) for c, rows in edits.items() for e in rows], f"clone_id string, {EDITS}")
    asked = spark.createDataFrame([(c, *g) for c, g in guides.items()], "clone_id string, guide string, pam string")
    every = audit.audit_clones(everything, starter, refs, wanted, asked, hypothesis=True)

    def told(a: audit.Audit) -> dict[str, list]:
        plain = lambda c, df: identity.all_bare(F.array_join(c, ",")) if dict(df.dtypes)[c].startswith("array") else identity.all_bare(F.col(c).cast("string"))
        out = {}
        for name, key in (("events", "event_id"), ("assessments", "edit_id"), ("sites", "seq_id"), ("unintended", "event_id")):
            df = getattr(a, name)
            for r in df.select(identity.scope(key).alias("_scope"), *(plain(c, df).alias(c) for c in sorted(df.columns))).collect():
                out.setdefault(r._scope, {}).setdefault(name, []).append(tuple("" if x is None else x for x in r[1:]))
        return {s: {n: sorted(rows) for n, rows in t.items()} for s, t in out.items()}

    got = told(every)
    assert set(got) == {"k1", "k2", "k3", "k.4", "twin"} and got["twin"]["events"] == got["k1"]["events"]
    for name in ("k1", "k2", "k.4"):
        mine = spark.createDataFrame(edits[name], EDITS) if name in edits else None
        g = guides[name]
        alone = audit.audit(spark.createDataFrame(clones[name], kinds), starter, refs, mine, g[0], sites.Nuclease("x", g[1]), hypothesis=True)
        assert got[name] == told(alone)[None], name
    assert [r[-3:] for r in got["k3"]["assessments"]] and set(got["k3"]) == {"assessments"}


def test_cohort_tables(spark):
    refs = spark.createDataFrame([("c", "ACGT" * 50)], "seq_id string, seq string")
    rows = spark.createDataFrame([("x", 1, "SNP", ["c", "5", "G"]), ("y", 1, "SNP", ["c", "5", "G"]), ("y", 2, "SNP", ["c", "9", "G"]), ("x", 3, "SNP", ["c", "20", "A"])], "clone_id string, id int, kind string, fields array<string>")
    starter = spark.createDataFrame([(1, "SNP", ["c", "20", "A"])], "id int, kind string, fields array<string>")
    r, m = audit.cohort_tables(rows, starter, refs, ["x", "y"])
    assert sorted((x.n_clones, x.scope) for x in r.collect()) == [(1, "clone_specific"), (2, "shared_all")]
    assert sorted((x.clone_x, x.clone_y) for x in m.collect()) == [(0, 1), (1, 1)]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = recurrence.recurrence_stream(source(), "event_type", "user_id", "ts", "60 days").writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r[0]: r[1] for r in events.groupBy("event_type").agg(F.count_distinct("user_id")).collect()}
    assert {r.event_type: r.n_clones for r in spark.table("seen").collect()} == want
    q = recurrence.windowed_counts(source(), "event_type", "ts", "1 day", "60 days").writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r[0], r[1]): r[2] for r in events.groupBy(F.date_trunc("day", "ts"), "event_type").count().collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("days").collect()} == want
