"""Repeat families, the fold over copies, and components, against plain Python from their definitions."""

import random
from collections import defaultdict

import pytest

from helixframe.operators import components, families, folding
from helixframe.operators.constructs import KEY
from helixframe.sources import products


@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {"random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], "chain": [(i, i + 1) for i in range(70)], "star": [(5, i) for i in range(60)] + [(100, 100)], "empty": []}[kind]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


# --- seeds of reads with many pieces


def end(start, span, reverse, first):
    return (start, False) if reverse == first else (start + span - 1, True)


def seeds_by_hand(rows, repeats, lengths, most, geometries):
    """(seeds, candidates) by enumerating every read's pairs of shapes."""
    reads, seeds, found = defaultdict(lambda: defaultdict(list)), {}, {}
    for q, mate, c, start, span, rev, a, b, n in rows:
        reads[q, mate][a, b, n, span, rev].append((c, start))
    for (q, mate), shapes in reads.items():
        if sum(map(len, shapes.values())) <= most:
            continue
        order = sorted(shapes)
        if len(order) * (len(order) - 1) // 2 > geometries:
            seeds[f"{q}:{mate}"] = ("limit", None, 0, len(order))
            continue
        for i, x in enumerate(order):
            for j in range(i + 1, len(order)):
                y, xs, ys = order[j], sorted(shapes[x]), sorted(shapes[order[j]])
                shared = max(0, min(x[1], y[1]) - max(x[0], y[0]))
                own = sorted((x[1] - x[0] - shared, y[1] - y[0] - shared))
                union = x[1] - x[0] + y[1] - y[0] - shared
                if not (x[0] == 0 and max(x[1], y[1]) == max(x[2], y[2]) and union > max(x[1] - x[0], y[1] - y[0]) + 2 and own[0] >= 5 and own[1] >= 10 and y[0] - x[1] <= 20) or len(xs) == len(ys) == 1:
                    continue
                left = [(c, *end(s, x[3], x[4], True)) for c, s in xs]
                right = [(c, *end(s, y[3], y[4], False)) for c, s in ys]
                goes_on = lambda p, r: p[0] == r[0] and p[2] and not r[2] and p[1] + 1 == r[1] and x[1] == y[0]
                ident = f"{q}:{mate}:{i + 1}:{j + 1}"
                if len(xs) > 1 and len(ys) > 1:
                    seeds[ident] = ("both", None, 0, len(xs) + len(ys))
                    continue
                anchor, copies = (left[0], right) if len(xs) == 1 else (right[0], left)
                kept = [p for p in copies if not (goes_on(anchor, p) if len(xs) == 1 else goes_on(p, anchor))]
                seeds[ident] = ("anchored" if kept else "trivial", anchor, len(kept), len(copies))
                inside = lambda p: [r for r in repeats if r[0] == p[0] and r[1] <= p[1] <= r[2]]
                ends = [p for p in kept if p[0] == anchor[0] and any(min(abs(p[1] - r[1]), abs(p[1] - r[2])) <= 20 for r in inside(p))]
                if kept and ends and not inside(anchor):
                    around = lambda p: min(abs(p[1] - anchor[1]), lengths[p[0]] - abs(p[1] - anchor[1]))
                    best = min(ends, key=lambda p: (around(p), p[1]))
                    one, two = (anchor, best) if len(xs) == 1 else (best, anchor)
                    if one[:2] > two[:2]:
                        one, two = (*two[:2], not two[2]), (*one[:2], not one[2])
                    found[ident] = (*one, *two, x[1] - y[0])
    return seeds, found


def test_family_seeds(spark):
    rng = random.Random(6)
    rows = []
    for q in range(12):
        for _ in range(rng.choice([5, 25, 40])):
            first = rng.random() < 0.5
            a, b = (0, rng.choice([40, 45])) if first else (rng.choice([40, 45]), 100)
            rows.append((f"r{q}", q % 2, rng.choice("cd"), rng.randrange(1, 400) if q % 3 else rng.choice([100, 140, 141, 300]), b - a, rng.random() < (0.5 if q % 2 else 0.1), a, b, 100))
    rows += [("lone", 1, "c", 61, 40, False, 0, 40, 100)] + [("lone", 1, "c", s, 60, False, 40, 100, 100) for s in [101, *range(200, 400, 10)]]
    rows += [("on", 1, "c", 61, 40, False, 0, 40, 100)] + [("on", 1, "c", 101, 60, False, 40, 100, 100)] * 25
    repeats = [("c", 90, 150, 1, "IS1", 0), ("c", 290, 320, -1, "IS1", 1), ("d", 10, 60, 1, "IS2", 2)]
    lengths = {"c": 460, "d": 470}
    pieces = spark.createDataFrame(rows, "qname string, mate int, seq_id string, start int, span int, reverse boolean, read_start int, read_end int, read_len int")
    contigs = spark.createDataFrame([(c, "A" * n) for c, n in lengths.items()], "seq_id string, seq string")
    table = spark.createDataFrame(repeats, "seq_id string, start int, `end` int, strand int, name string, ord int")
    for geometries in (families.GEOMETRIES, 20):
        want, chosen = seeds_by_hand(rows, repeats, lengths, 20, geometries)
        seeds, candidates = families.family_seeds(pieces, table, contigs, 20, geometries)
        kinds = {families.TRIVIAL: "trivial", families.BOTH_SIDES: "both", families.LIMITS["geometry"]: "limit", None: "anchored"}
        got = {r.id: (kinds[r.rejection], tuple(r.anchor) if kinds[r.rejection] in ("anchored", "trivial") else None, len(r.eligible), r.placement_count) for r in seeds.collect()}
        assert got == want
        assert {r.id: (r.seq_id1, r.pos1, r.minus1, r.seq_id2, r.pos2, r.minus2, r.overlap) for r in candidates.collect()} == chosen
        assert {v[0] for v in got.values()} >= ({"limit"} if geometries == 20 else {"anchored", "both", "trivial"})
    assert chosen or want


# --- families of seeds


def records_by_hand(seeds, entries, candidates):
    """(anchor, copies or family) to (state, molecules, plus, minus, reasons), seed by seed."""
    seeds = [dict(zip(families.SEED, s)) for s in seeds if s[families.SEED.index("rejection")] != families.TRIVIAL]
    bad = {s["family"] for s in seeds if s["limit"] or not s["complete"]}

    def limit(s, why):
        s.update(limit=s["limit"] or why, complete=False, eligible=[])

    for s in seeds:
        if s["family"] in bad:
            limit(s, families.LIMITS["family"])
    usable = lambda s: s["complete"] and not s["limit"] and s["anchored"]
    if sum(len(s["eligible"]) for s in seeds if usable(s)) > entries:
        for s in seeds:
            limit(s, families.LIMITS["index"])
    before = [dict(s) for s in seeds]
    for s in seeds:
        s["by"], s["reciprocal"] = None, False
        here = [o for o in before if usable(o) for p in o["eligible"] if p == s["anchor"]]
        if not usable(s) or len(s["eligible"]) < 2:
            continue
        if len(here) > candidates:
            limit(s, families.LIMITS["candidates"])
            continue
        met = [o for o in here if o["id"] != s["id"] and o["molecule"] != s["molecule"] and o["overlap"] == s["overlap"] and o["geometry"] == s["geometry"] and o["anchor"] in s["eligible"]]
        if len({o["anchor"] for o in met}) == 1:
            s.update(eligible=[met[0]["anchor"]], by=min(met, key=lambda o: o["id"])["molecule"], reciprocal=True)
    groups = defaultdict(list)
    for s in seeds:
        groups[s["anchor"], s["overlap"], tuple(sorted(set(s["eligible"]))) if usable(s) else s["family"]].append(s)
    out = {}
    for key, group in groups.items():
        mols = defaultdict(list)
        for s in sorted(group, key=lambda s: (s["source"], s["molecule_minus"], s["clip_length"], s["aligned_length"], s["id"])):
            mols[s["molecule"]].append(s)
        sides = [(m[0]["molecule_minus"], max(s["aligned_length"] for s in m), max(s["clip_length"] for s in m)) for m in mols.values()]
        short = lambda minus: max((min(a, c) for m, a, c in sides if m == minus), default=0)
        counts = [sum(m == minus for m, _, _ in sides) for minus in (False, True)]
        least = [min((x for x in xs if x), default=0) for xs in ([a for _, a, _ in sides], [c for _, _, c in sides])]
        good = all(s["anchored"] for s in group) and min(counts) > 0 and max(short(True), short(False)) >= 14 and min(short(True), short(False)) >= 9 and min(least) >= 3
        copies = {p for s in group for p in s["eligible"]}
        if any(s["limit"] or not s["complete"] or s["placement_count"] > families.PLACEMENTS for s in group):
            state = "RESOURCE_LIMIT"
        elif len(copies) == 1 and good and any(s["by"] is not None and s["by"] not in mols for s in group):
            state = "RESOLVED"
        else:
            state = "SUPPORTED_AMBIGUOUS" if len(copies) > 1 and good else "CANDIDATE"
        out[key] = (state, len(mols), *counts, sorted({s[c] for s in group for c in ("rejection", "limit") if s[c]}))
    return out


@pytest.mark.parametrize(("entries", "candidates"), [(10**6, 10**6), (10**6, 12), (100, 10**6)])
def test_family_records(spark, entries, candidates):
    rng = random.Random(8)
    place = lambda p: ("c", p, p % 2 == 0)
    seeds = []
    for i in range(260):
        p = rng.randrange(12)
        copies = [place(p ^ 1), place(100 + p)] if p < 5 else [place(100 + p), place(200 + p)] if p < 9 else [place(rng.randrange(12)) for _ in range(rng.randrange(3))]
        copies = sorted(set(copies))
        seeds.append((f"s{i:03}", rng.choice(["PRIMARY_CLIP", "STAGE2_MOSAIC"]), place(p), copies, copies, rng.choice([2, 2, 2, 5000]) if p == 8 else 2, f"F{p}:{rng.randrange(2)}", not (p == 7 and rng.random() < 0.02), rng.choice([0, 0, 0, 3]), rng.randrange(160), rng.random() < 0.5, rng.randrange(2, 40), rng.randrange(2, 40), rng.randrange(3), None, "G", p != 10, rng.choice([None, families.TRIVIAL]) if p == 11 else None, None))
    table = spark.createDataFrame(seeds, "id string, source string, anchor struct<seq_id:string,pos:long,minus:boolean>, observed array<struct<seq_id:string,pos:long,minus:boolean>>, eligible array<struct<seq_id:string,pos:long,minus:boolean>>, placement_count long, family string, complete boolean, overlap long, molecule long, molecule_minus boolean, clip_length long, aligned_length long, mapq int, score int, geometry string, anchored boolean, rejection string, limit string")
    want = records_by_hand(seeds, entries, candidates)
    records = families.repeat_families(table, entries, candidates)
    rows = records.collect()
    got = sorted((tuple(r.anchor), r.overlap, r.state, r.molecules, r.plus, r.minus, r.reasons) for r in rows)
    assert got == sorted((k[0], k[1], v[0], *v[1:]) for k, v in want.items())
    states = {r.state for r in rows}
    assert states == {"RESOURCE_LIMIT"} if entries == 100 else states >= set(families.STATES) - ({"RESOLVED"} if candidates == 12 else set())
    header, lines = products.repeat_ambiguous(families.table_rows(records, spark.createDataFrame([("c",)], "seq_id string")), "s")
    assert lines.count() == len(rows) and len(header) == 31 and all(len(r[0].split("\t")) == 31 for r in lines.collect())
    assert families.repeat_families(table.limit(0)).count() == 0


# --- the fold over copies


def fold_by_hand(rows, repeats, length):
    """Families in order, each with its shown member; the rules read once more, with the whole list in one loop."""
    tol = 5
    term = lambda p: next((r for r in repeats if min(abs(p - r[1]), abs(p - r[2])) <= 20), None)
    inner = lambda p: next((r for r in repeats if r[1] <= p <= r[2]), None)

    def locus(p, minus):
        r = term(p) or inner(p)
        if r is None:
            return None
        a, b = abs(p - r[1]), abs(p - r[2])
        at_start = a <= tol and (b > tol or a <= b)
        at_end = b <= tol and not at_start
        which = (5 if r[3] >= 0 else 3) if at_start and not minus else (3 if r[3] >= 0 else 5) if at_end and minus else None
        return r[4], p - r[1] if r[3] >= 0 else r[2] - p, which

    def near(x, y):
        return x[1] == y[1] and abs(x[0] - y[0]) <= tol

    def outside(j):
        return any((r := term(p)) and (0 < r[1] - p <= 5 if r[3] >= 0 else 0 < p - r[2] <= 5) for p, _ in j["sides"])

    def distance(j):
        (p, _), (q, _) = j["sides"]
        free = lambda x: term(x) is None and inner(x) is None
        return min(abs(p - q), length - abs(p - q)) if term(p) and free(q) or term(q) and free(p) else None

    groups = []
    for j in sorted(rows, key=lambda j: (*sorted(j["sides"]), j["id"])):
        for g in groups:
            s = g["shown"]
            shared = [x for x in s["sides"] if any(near(x, y) for y in j["sides"])]
            a, b = s["overlap"], j["overlap"]
            if g["cigar"] and j["cigar"] or not shared or (a > 0) - (a < 0) != (b > 0) - (b < 0) or abs(a - b) > tol:
                continue
            u = [x for x in s["sides"] if not any(near(x, y) for y in j["sides"])]
            v = [y for y in j["sides"] if not any(near(x, y) for x in s["sides"])]
            lu, lv = (locus(*u[0]), locus(*v[0])) if len(u) == len(v) == 1 else (None, None)
            if (len(u) == 1) != (len(v) == 1) or (lu is None) != (lv is None):
                continue
            if lu and (lu[0] != lv[0] or (lu[2] != lv[2] if lu[2] or lv[2] else abs(lu[1] - lv[1]) > tol)):
                continue
            both = len(g["ids"] & j["ids"])
            flank = lu and lu[2] and any(term(x[0]) is None and inner(x[0]) is None for x in shared)
            if not (2 * both > min(len(g["ids"]), len(j["ids"])) > 0 or flank):
                continue
            most = max(j["plus"] + j["minus"], s["plus"] + s["minus"])
            rank = []
            for x, y in ((j, s), (s, j)):
                dx, dy = distance(x), distance(y)
                rank.append((x["plus"] + x["minus"] + 2 >= most, outside(x), -dx if dx is not None and dy is not None else 0, x["plus"] + x["minus"], x["seeds"]))
            mine = {"ids": set(j["ids"]), "plus": j["plus"], "minus": j["minus"]}
            kept, come, shown = (mine, g, j) if rank[0] > rank[1] else (g, mine, s)
            fresh, n = len(come["ids"] - kept["ids"]), len(come["ids"])
            plus, minus = (kept[c] + (come[c] if fresh == n else come[c] * fresh // n) for c in ("plus", "minus"))
            g.update(shown=shown, plus=plus, minus=minus, ids=g["ids"] | j["ids"], cigar=g["cigar"] or j["cigar"], members=g["members"] + [j["id"]])
            break
        else:
            groups.append({"shown": j, "ids": set(j["ids"]), "plus": j["plus"], "minus": j["minus"], "cigar": j["cigar"], "members": [j["id"]]})
    return sorted((g["shown"]["id"], g["plus"], g["minus"], sorted(g["ids"]), sorted(g["members"])) for g in groups)


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_over_copies(spark, seed):
    rng = random.Random(seed)
    repeats = [("c", 200, 280, 1, "IS1", 0), ("c", 500, 580, -1, "IS1", 1), ("c", 800, 880, 1, "IS1", 2), ("c", 1000, 1060, 1, "IS2", 3)]
    rows = []
    for i in range(70):
        flank = rng.choice([60, 64, 120, 700, 240])
        r = rng.choice(repeats)
        at = rng.choice([r[1], r[2], r[1] - 3, r[2] + 2, r[1] + 30, r[1] + 33])
        sides = [(flank + rng.randrange(3), rng.random() < 0.5), (at + rng.randrange(2), at - r[1] > 40)]
        if rng.random() < 0.3:
            sides.reverse()
        ids = set(rng.sample(range(40), rng.randrange(4)))
        rows.append({"id": i, "sides": sides, "overlap": rng.choice([0, 0, 2, 4, -2]), "plus": rng.randrange(9), "minus": rng.randrange(9), "seeds": rng.randrange(4), "ids": ids, "cigar": rng.random() < 0.2})
    table = spark.createDataFrame(
        [(j["id"], "c", j["sides"][0][0], j["sides"][0][1], "c", j["sides"][1][0], j["sides"][1][1], j["overlap"], j["plus"] + j["minus"], j["plus"], j["minus"], 9, 8, 7, 5, 0, j["seeds"], sorted(j["ids"]), j["cigar"]) for j in rows],
        "id long, seq_id1 string, pos1 long, minus1 boolean, seq_id2 string, pos2 long, minus2 boolean, overlap long, reads long, plus long, minus long, best_min long, best_min_plus long, best_min_minus long, min_side1 long, min_side2 long, seed_reads long, ids array<long>, has_cigar boolean",
    )
    assert set(KEY) < set(table.columns)
    contigs = spark.createDataFrame([("c", "A" * 1200)], "seq_id string, seq string")
    copies = spark.createDataFrame(repeats, "seq_id string, start long, `end` long, strand int, name string, ord int")
    got = folding.fold_copies(table, copies, contigs).collect()
    assert sorted((r.id, r.plus, r.minus, list(r.ids), list(r.members)) for r in got) == fold_by_hand(rows, repeats, 1200)
    assert any(len(r.members) > 1 for r in got)
