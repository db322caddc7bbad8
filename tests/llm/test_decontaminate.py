from tidemark.llm import decontaminate as D

ITEM = "A train leaves Boston at 9 with 120 passengers and travels 300 km toward Denver before the conductor named Alice counts every seat again and finds 15 empty"
SWAPPED = ITEM.replace("Boston", "Paris").replace("Denver", "Lyon").replace("Alice", "Bob").replace("120", "77").replace("300 km", "45 miles").replace("15", "3.5")
BROKEN = "the route from Boston to Denver was long and the guide told us that Boston lies far from Denver while people who live near Boston seldom travel to Denver in winter"
BROKEN_SWAP = "the route from Paris to Lyon was long and the guide told us that Rome lies far from Oslo while people who live near Bern seldom travel to Kiev in winter"
FILL = "some other words stand here and they have nothing in common with any question that was ever asked by anyone at all"


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, item string, pos int")
    b = spark.createDataFrame(items, "item_id long, text string, doc_id long")
    return {(r["doc_id"], r["item_id"]): r for r in D.matches(d, b, **kw).collect()}


def test_copies_and_reparameterised_copies(spark):
    docs = [(1, ITEM), (2, FILL + ". " + ITEM + ". " + FILL), (3, f"{FILL} {SWAPPED} {FILL}"), (4, FILL), (5, None), (6, ""), (7, ITEM[:40]), (8, " ".join(ITEM.split()[::-1])), (9, ITEM.lower()), (None, ITEM), (1, ITEM)]
    got = run(spark, [(*x, "i", 0) for x in docs], [(10, ITEM, 0), (11, None, 0), (12, "too short", 0), (13, "", 0)])
    assert {k[0] for k in got} == {1, 2, 3, None} or {k[0] for k in got} == {1, 2, 3, 9, None}
    assert got[1, 10]["verbatim"] and got[2, 10]["verbatim"] and not got[3, 10]["verbatim"]
    assert got[1, 10]["coverage"] > 0.9 and all(r["contaminated"] for r in got.values())


def test_slots_must_be_consistent(spark):
    same = BROKEN.replace("Boston", "Paris").replace("Denver", "Lyon")
    got = run(spark, [(1, same, "", 0), (2, BROKEN_SWAP, "", 0), (3, BROKEN, "", 0)], [(5, BROKEN, 0)])
    assert {k[0] for k in got} == {1, 3}


def test_repeated_items_and_empty_tables(spark):
    assert set(run(spark, [(1, ITEM, "", 0)], [(1, ITEM, 0), (2, ITEM, 0)])) == {(1, 1), (1, 2)}
    assert run(spark, [], [(1, ITEM, 0)]) == {} and run(spark, [(1, ITEM, "", 0)], []) == {}


def test_every_planted_passage_and_no_clean_text(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(docs, bench).collect()}
    texts, items = [tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()]
    want = {(i, j) for i, t in texts for j, q in items if q in t}
    assert want <= got and len(got - want) <= 2


def test_canonical_words():
    import numpy as np

    text = b"In Rome 3,500.5 kg of Iron and 12 km. Then he sat; km alone"
    c, h, typed, d = D.canonical(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    names = {D.NUM: "NUM", D.UNIT: "UNIT", D.NAME: "NAME"}
    assert [names.get(int(x), "-") for x in c] == ["-", "NAME", "NUM", "UNIT", "-", "NAME", "-", "NUM", "UNIT", "-", "-", "-", "-", "-"]


def test_copies_of_any_case_length_and_share_of_typed_words(spark):
    items = [(1, ITEM, 0), (2, "Who wrote Émile?", 0), (3, "Name 3 Red Fish From Lake Como In 1990 And 1991", 0), (4, "Sodium", 0), (5, "?!", 0), (6, "Die Straße nach Österreich führt Über Köln und Bonn dann Weiter", 0)]
    docs = [(1, ITEM.upper()), (2, ITEM.title()), (3, ITEM.lower()), (4, f"{FILL} “who wrote ÉMILE”, {FILL}"), (5, f"{FILL}: {items[2][1]}. {FILL}"), (6, "it is SODIUM. Sodium"), (7, items[5][1].upper()), (8, "who wrote it and who read Émile ?!"), (9, FILL)]
    got = run(spark, [(*x, "i", 0) for x in docs], items)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 3), (6, 4), (7, 6)}
    assert all(r["coverage"] == 1 and r["verbatim"] for r in got.values())


def test_a_conflict_costs_its_windows_only(spark):
    item = "we bought 5 apples at the old market and then the driver took us over 20 hills and along 30 rivers until all of us were very tired so that in the end we gave 5 coins to him"
    two = item.replace("bought 5", "bought 8").replace("20", "21").replace("30", "31").replace("gave 5", "gave 9")
    one = item.replace("gave 5", "gave 9").replace("20", "21").replace("30", "31")
    got = run(spark, [(1, two, "", 0), (2, one, "", 0)], [(5, item, 0)])
    assert {k[0] for k in got} == {1, 2} and not any(r["verbatim"] for r in got.values())


def naive(docs, items, size=8, least=5, run=13, cover=0.6):
    """{(id, item): (n_matched, coverage, verbatim)} by comparing every window of every text with every window of every item."""
    import re

    import numpy as np

    def words(text):
        raw = (text or "").encode()
        return [x.tolist() for x in D.canonical(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[:3]]

    def plain(text):
        text = text or ""
        text = text if text.isascii() else re.sub(r"[^\w\x00-\x7F]+", " ", text.casefold())
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())

    out = {}
    for i, t in docs:
        for j, q in items:
            if q is None:
                continue
            results = []
            ct, ht, _ = words(t)
            cq, hq, yq = words(q)
            on = {}
            for a in range(len(cq) - size + 1):
                if sum(not y for y in yq[a : a + size]) >= least:
                    for p in range(len(ct) - size + 1):
                        if ct[p : p + size] == cq[a : a + size]:
                            on.setdefault(p - a, {})[a] = [(hq[a + x], ht[p + x]) for x in range(size) if yq[a + x]]
            results.append((on, size, len(cq)))
            pt, pq = plain(t), plain(q)
            w = min(size, len(pq))
            on = {}
            for a in range(len(pq) - w + 1 if w else 0):
                for p in range(len(pt) - w + 1):
                    if pt[p : p + w] == pq[a : a + w]:
                        on.setdefault(p - a, {})[a] = []
            results.append((on, w, len(pq)))
            best = []
            for on, w, n in results:
                covered, most, same = set(), 0, True
                for windows in on.values():
                    pairs = {x for s in windows.values() for x in s}
                    torn = {x for x, _ in pairs if len({y for z, y in pairs if z == x}) > 1}
                    good = {a: s for a, s in windows.items() if all(x == y for x, y in s) or not any(x in torn for x, _ in s)}
                    mine = {a + x for a in good for x in range(w)}
                    covered |= mine
                    most = max(most, len(mine))
                    same &= all(x == y for s in good.values() for x, y in s)
                share = round(len(covered) / n, 6) if n else 0
                if covered and (most >= run or share >= cover):
                    best.append((share, len(covered), same))
            if best:
                out[i, j] = max([*best, out.get((i, j), (0,))])
    return out


def test_matches_are_brute_force(spark):
    """Random texts of names, numbers, units and few words, whole items, parts of them, changed ones and repeated rows."""
    import random

    r = random.Random(11)
    vocab = "the a of Rome Paris Anna km kg 5 12 3,000 and sees red old town goes to with over under Lake".split()
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([3, 7, 9, 14, 25, 40])))) for k in range(12)] + [(20, ITEM), (21, None), (22, "?"), (23, "Why is the sky blue at noon?"), (24, "What is 12 + 35 * 7 - 8 / 4 + 9 - 3 + 100 - 7 + 55"), (25, BROKEN)]
    docs = []
    for n in range(120):
        k, text = r.choice(items[:13] + items[15:])
        w = (text or "").split()
        lo = r.randrange(max(1, len(w) // 2))
        w = w[lo : lo + r.choice([5, 12, 20, 60])]
        for _ in range(r.randrange(4)):
            if w:
                w[r.randrange(len(w))] = r.choice(vocab)
        docs.append((n % 100, f"{' '.join(r.choice(vocab) for _ in range(r.randrange(6)))} {' '.join(w)} {r.choice(['', 'end', w[0] if w else ''])}"))
    docs += [(200, ITEM), (200, SWAPPED), (None, ITEM), (None, FILL), (201, BROKEN_SWAP), (202, None), (203, "")]
    got = {k: (x["coverage"], x["n_matched"], x["verbatim"]) for k, x in run(spark, [(*x, "i", 0) for x in docs], [(*x, 0) for x in items]).items()}
    assert got == naive(docs, items) and len(got) > 20


def test_rows_of_one_id_are_judged_by_themselves(spark):
    got = run(spark, [(1, ITEM, "", 0), (1, SWAPPED, "", 0)], [(5, ITEM, 0)])
    assert got[1, 5]["verbatim"] and got[1, 5]["coverage"] == 1
