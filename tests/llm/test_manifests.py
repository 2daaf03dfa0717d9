"""Chat formatting, the Merkle manifest and the prefix trie: odd rows, empty tables, and results against plain Python and SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from helixframe.llm import chat, merkle, queries, trie

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("none")
    for name in ("documents", "conversations"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).withColumn("formatted", F.lit(1)).write.parquet(f"{top}/{name}.parquet")
    return str(top)


@pytest.mark.parametrize("name", ["op11_chat", "op12_merkle", "op13_trie"])
def test_queries_agree_with_sql(spark, empty, name):
    out = queries.QUERIES[name](spark, SMALL)
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = db.sql(queries.ORACLES[name])
    assert out.columns == want.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want.fetchall(), key=str)
    nothing = queries.QUERIES[name](spark, empty)
    assert nothing.columns == out.columns and [r.conv_id for r in nothing.collect()] == [-7] if name == "op11_chat" else nothing.count() == 0


# --- chat


def odd_turns():
    draw = random.Random(5)
    bits = ["### ", "</turn>", "\\", ": ", "#", "\n", "<", "/", "a", "</turn>\n", "##\\# ", "é", "$1", "x" * 5000]
    role = lambda: draw.choice(["user", "assistant", "assistant", None, "", "".join(draw.choices(bits[:-1], k=3))])
    text = lambda: draw.choice([None, "", "".join(draw.choices(bits, k=draw.randint(1, 9)))])
    rows = [(draw.choice([None, *range(-3, 60)]), draw.choice([None, 0, 1, 2, 3, 3]), role(), text()) for _ in range(600)]
    return rows + rows[:20]


def in_order(rows):
    """By conversation, its (role, text) by turn, null first, ties by role and text as their bytes order them."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for _, r, t in sorted(v)] for c, v in out.items()}


def parsed(text):
    """The grammar once more, as a loop over the text."""
    out, at = [], 0
    un = lambda x: re.sub(r"(?s)\\(.)", r"\1", x)
    while at < len(text):
        assert text.startswith("### ", at)
        role_end = text.index(": ", at + 4)
        end = text.index("</turn>", role_end)
        assert "### " not in text[at + 4 : end] and text[end + 7] == "\n"
        out.append((un(text[at + 4 : role_end]), un(text[role_end + 2 : end])))
        at = end + 8
    return out


def test_chat_round_trip(spark):
    rows = odd_turns()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "position": F.lit("x"), "made": F.lit(2), "start": F.lit(3)})
    formatted = chat.format_turns(turns).cache()
    assert {r.level for r in formatted.select("level").distinct().collect()} == {0, 1, 2}
    want = in_order(rows)
    texts = {r.conv_id: r for r in chat.conversations(formatted).collect()}
    assert set(texts) == set(want)
    for conv, r in texts.items():
        assert parsed(r.formatted) == want[conv]
        masked = [re.sub(r"(?s)\\(.)", r"\1", r.formatted[s.start : s.end]) for s in r.loss_spans]
        learned = [t for role, t in want[conv] if role == "assistant"]
        assert masked == [t for t in learned if t] and r.masked == "".join(learned)
    for r in chat.read_back(chat.conversations(formatted)).collect():
        own = want[r.conv_id]
        learned = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(learned), sha(learned), len(texts[r.conv_id].formatted))
    assert "Python" not in (plan := chat.read_back(chat.conversations(chat.format_turns(turns)))._jdf.queryExecution().toString()) and "Arrow" not in plan


def test_chat_escapes_no_more_than_it_must(spark):
    texts = ["plain", "a < b, \\", "### x", "</turn>", "\\n", chat.AWKWARD, "####", ": "]
    turns = spark.createDataFrame([(i, 0, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    levels = {r.conv_id: r.level for r in chat.format_turns(turns).collect()}
    assert [levels[i] for i in range(len(texts))] == [0, 0, 1, 1, 2, 2, 0, 0]


@pytest.mark.parametrize("text", ["x", "### user", "### user: a", "### user: a</turn>", "### user: a</turn>\n ", "### a</turn>: b\n", "### user: a</turn>b</turn>\n", "### a: b</turn>\n### c"])
def test_chat_parser_refuses(spark, text):
    assert spark.range(1).select(chat.parse(F.lit(text)).alias("p")).first().p is None


# --- the manifest


def h(*inputs):
    return sha("".join(inputs))


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def manifest(rows):
    """The manifest by its definition: rows of (doc_id, text, lang, source, n_chars)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = defaultdict(list)
    for doc, text, lang, source, n in rows:
        other = text.translate(lower) if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 else text
        made = [h(*map(field, (doc, source, lang, n, x))) for x in (text, other)]
        by[lang].append(((doc is not None, doc or 0), *made, doc))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = [up([x[1] for x in sorted(by[lang])]) for lang in langs]
    top = up([t[-1][0] for t in trees])
    out = []
    for at, (lang, tree) in enumerate(zip(langs, trees)):
        for i, (_, leaf, other, doc) in enumerate(sorted(by[lang])):
            steps, node = [], other
            for levels, place in ((tree, i), (top, at)):
                for level in levels[:-1]:
                    first = place - place % 8
                    left, right = level[first:place], level[place + 1 : first + 8]
                    steps += left + right
                    node = h(*left, node, *right)
                    place //= 8
            out.append((doc, leaf, tree[-1][0], top[-1][0], h(*steps), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize(("levels", "langs"), [((4, 7), 3), ((1, 7), 20), ((1, 1), 3)])
def test_manifest_by_its_definition(spark, monkeypatch, levels, langs):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    draw = random.Random(7)
    tags = [None, "", *(f"l{i}é" for i in range(langs - 2))]
    rows = [(draw.choice([None, i, -i, i]), draw.choice([None, "", f"Text {i}", "LONG " * 4000]), draw.choice(tags[:2] + tags), draw.choice([None, "s"]), draw.choice([None, i])) for i in range(700)]
    rows += [(8, "One", "alone", None, 3)] + rows[:30]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"leaf": F.lit(0), "part": F.lit(1), "block": F.lit(2), "number": F.lit(3)})
    got = list(map(tuple, merkle.manifest(docs.repartition(5)).collect()))
    assert sorted(got, key=str) == sorted(manifest(rows), key=str)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_refuses_a_top_tree_that_is_too_large(spark, monkeypatch):
    monkeypatch.setattr(merkle, "TOP_NODES", 40)
    docs = spark.createDataFrame([(i, "t", str(i), None, 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    with pytest.raises(ValueError, match="top tree"):
        merkle.manifest(docs)


def test_blocks_grow_before_the_top_tree_does(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", (1, 7))
    monkeypatch.setattr(merkle, "TOP_NODES", 32)
    rows = [(i, "t", "x", None, 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, merkle.manifest(docs).collect())) == sorted(manifest(rows))


# --- the trie


def nodes(rows):
    """The trie by its definition."""
    own = {c: v for c, v in in_order([r for r in rows if r[0] is not None]).items()}
    for c in own:  # ties stand by their digest here
        ties = defaultdict(list)
        for conv, turn, role, text in rows:
            if conv == c:
                role, text = role or "", text or ""
                ties[(turn is not None, turn or 0)].append((sha(f"{len(role.encode())}:{role}{text}")[:32], len(text.encode()), role, text))
        own[c] = [(r, t) for turn in sorted(ties) for _, _, r, t in sorted(ties[turn])]
    paths = {}
    for c in own:
        n = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:n] + own[c][n:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = []
    for p, ms in members.items():
        under = [q for q in members if q[: len(p)] == p]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in ms if paths[c] == p)))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), sum(len(q) == len(p) + 1 for q in under), sum(map(leaf, under)), saved, sha(ends)))
    return out


def turns_with_copies(draw):
    rows = []
    for c in (None, *range(-12, 60)):
        kind = draw.random()
        for t in range(draw.choice([1, 1, 2, 3, 6, 12])):
            rows.append((c, draw.choice([t, None, 0]) if kind < 0.2 else t, draw.choice(["user", None]), draw.choice(["a", "bé", None]) if kind < 0.7 else f"own {c} {t}"))
    for c in range(100, 130):
        rows += [(c, t, "user", "same") for t in range(4)]
    return rows + rows[:9]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("size", [40, 16 << 20])
def test_trie_by_its_definition(spark, monkeypatch, seed, size):
    """With ranges of a few bytes almost every node spans ranges; with the usual ones none but the first path's does."""
    monkeypatch.setattr(trie, "RANGE_BYTES", size * 10)
    monkeypatch.setattr(trie, "RUN_ROWS", 7 if size == 40 else 8192)
    rows = turns_with_copies(random.Random(seed))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"block": F.lit(0), "code": F.lit("x"), "part": F.lit(1), "key": F.lit(2)})
    got = list(map(tuple, trie.prefix_trie(turns.repartition(3)).collect()))
    assert sorted(got, key=str) == sorted(nodes(rows), key=str)


def test_one_long_conversation(spark):
    rows = [(3, t, "user", f"t{t % 7}") for t in range(1500)] + [(8, t, "user", f"t{t % 7}") for t in range(1500)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = trie.prefix_trie(turns).agg(F.count("*"), F.max("depth"), F.max("n_convs"), F.max("n_leaves")).first()
    assert got[0] > 1500 and got[1] <= 1500 and got[2] == 2


def test_merge_by_a_loser_tree():
    draw = random.Random(3)
    code = lambda i: bytes([i]) * trie.CODE
    paths = [(b"".join(code(draw.randint(0, 2)) for _ in range(draw.randint(0, 9))), c) for c in range(500)]
    for n in (1, 2, 3, 7, 40):
        runs = [trie.sorted_run(paths[i::n]) for i in range(n)]
        merged = list(trie.LoserTree([iter(r) for r in runs]))
        assert [x[:2] for x in merged] == sorted(paths)
        last = b""
        for path, _, lcp in merged:
            assert lcp == trie.shared(last, path) == next((i for i in range(10) if last[i * 20 : i * 20 + 20] != path[i * 20 : i * 20 + 20] or len(path) < i * 20 + 20), 10)
            last = path
    assert list(trie.LoserTree([])) == [] and list(trie.LoserTree([iter([]), iter([(b"", 1, 0)])])) == [(b"", 1, 0)]
