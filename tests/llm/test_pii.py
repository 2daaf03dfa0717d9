"""Personal data against brute force with Python's regular expressions, discovery by context, and redaction."""

import hashlib
import random
import re

import pytest

from helixframe.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    t, out = text or "", []
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(digits(x)) <= 19 and luhn(digits(x))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    }
    for kind, (pattern, holds) in kinds.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, t) if holds(m[0])]
    return out


ODD = [
    None, "", "a@b.c_x@d.e", "a@b.c@d.e x@y..z 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0000255", "1" * 4000, ".a" * 2000 + "@b" + ".c" * 2000, "+1 (1 1) 1-1.1 11111 +1+2+33333333333",
    "\U0001f600 4111 1111 1111 1111 x", "4111-1111-1111-1111", "12 34", "Call +1 (212) 555-0100. é 1.1.1.1.", "Call +1 (212) 555-0100. é 1.1.1.1.", "x@y.z " * 3000,
]


def check(rows, table):
    got = {}
    for r in pii.report(table).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        want = base(t)
        r = got[i][0]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), (i, want[:3], r.spans[:99])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in pii.KINDS[:4]]
        assert [x for x in r.spans.split(",") if x and not x.startswith("id")] == [f"{k}:{a}:{b}" for k, a, b in want]
    assert sum(map(len, got.values())) == len(rows)


def test_base_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check([(r.doc_id, r.text) for r in docs.collect()], docs)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "q@w.e")]
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, kind string, start int")
    check(rows, table)
    assert pii.report(table.limit(0)).count() == 0


@pytest.fixture(scope="module")
def staff(spark):
    rows = [(i, f"note {i}\nstaff mail: user{i}@example.org ok") for i in range(12)] + [(50, "staff mail: jk-20417-example, and more"), (51, "version 10.2.3-beta")]
    return spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars int")


def test_contexts_discover(staff):
    got = {r.doc_id: r for r in pii.report(staff).collect()}
    assert got[50].spans == "id:12:28" and got[50].n_id == 1 and got[51].n_id == 0 and got[3].n_email == 1 and got[3].n_id == 0
    assert {r.context for r in pii.score_contexts(pii.mentions(staff)).collect()} == {"mail:", "staff mail:"}


def test_redaction(spark, staff):
    got = {r.doc_id: r for r in pii.redact(staff).collect()}
    assert got[50].text == "staff mail: [ID], and more" and got[50].n_chars == len(got[50].text) and got[51].text == "version 10.2.3-beta"
    table = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)] + [(None, "q@w.e and 1.2.3.4", "y"), (None, None, "z")], "doc_id long, text string, kind string")
    out = pii.redact(table)
    assert out.columns == table.columns and out.count() == len(ODD) + 2
    got = {r.doc_id: r.text for r in out.where("doc_id is not null").collect()}
    assert got[0] is None and got[2] == "[EMAIL][EMAIL]" and got[3] == "[EMAIL]@d.e x@y..z [IP].[IP] 256.1.1.1 [IP]" and got[10] == "Call [PHONE]. é [IP]."
    assert {r.text for r in out.where("doc_id is null").collect()} == {"[EMAIL] and [IP]", None}


def test_redaction_leaves_other_columns_alone(spark):
    """Whatever they are called: every name that the operator gives to columns of its own, now or before, and awkward ones."""
    names = ["_h", "_g", "_id", "_s", "h", "rid", "kind", "start", "end", "value", "context", "contexts", "free", "spans", "words", "before", "score", "a.b", "x y", "k"]
    rows = [(1, "write to a@b.cd", 15, *names), (1, "write to a@b.cd", 15, *names), (2, None, None, *names), (None, "", 0, *names)]
    table = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, n_chars int"] + [f"`{n}` string" for n in names]))
    out = pii.redact(table)
    assert out.columns == table.columns
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(1, "write to [EMAIL]", 16, *names)] * 2 + [(2, None, None, *names), (None, "", 0, *names)], key=str)


def test_precision_and_recall_of_discovered_ids(spark):
    """Ids of three forms behind two phrases whose other instances are emails and phones, among tokens with digits behind other words."""
    draw = random.Random(11)
    rows, planted = [], {}
    for i in range(400):
        phrase = draw.choice(["staff contact:", "reach owner"])
        rows.append((i, f"Entry {i}. {phrase} " + draw.choice([f"u{i}@example.org", f"+49 30 {draw.randint(1000000, 9999999)}"]) + " is known."))
    for i in range(400, 600):
        phrase = draw.choice(["staff contact:", "reach owner"])
        text = f"Entry {i}. {phrase} "
        value = draw.choice([f"AB-{i}-{draw.randint(100, 999)}", f"usr_{draw.randint(10000, 99999)}", f"{draw.randint(10, 99)}/{i}/{draw.randint(10, 99)}x"])
        planted[i] = (len(text), len(text) + len(value))
        rows.append((i, f"{text}{value} is known."))
    for i in range(600, 1000):
        rows.append((i, f"Entry {i}. " + draw.choice(["built with", "chapter no", "as of", "release tag"]) + f" v{draw.randint(100, 999)}.{i}.0-rc and more."))
    got = {r.doc_id: [x.split(":")[1:] for x in r.spans.split(",") if x.startswith("id:")] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {(i, int(a), int(b)) for i, spans in got.items() for a, b in spans}
    true = {(i, *span) for i, span in planted.items()}
    assert len(found & true) >= 0.9 * len(true) and len(found & true) >= 0.9 * len(found)
