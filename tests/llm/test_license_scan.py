import re

from tidemark.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))


def brute(text):
    w = words(text)
    hits = [(i, label) for p, label in L.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = [
    "GNU General Public-License and the MIT license; MIT LICENSE!",
    "Licensed under CC BY-NC 4.0.",
    "cc\nby cc by cc by",
    "This work is licensed under the GNU General Public License, version 3.",
    "This fine work is, well, licensed under the GNU General Public License version 3",
    "gnu general public gnu general public license",
    "dedicated to the public domain under CC0 1.0 universal",
    "mit the license apacheé license",
]


def test_base_is_brute_force(spark, docs, rows):
    df = docs.select("doc_id", "text", "row", "kept").unionByName(spark.createDataFrame([(1000 + i, t, 1, "") for i, t in enumerate(TEXTS)], "doc_id long, text string, row long, kept string"))
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in L.scan(df).collect()), key=repr)
    assert got == sorted([(i, *brute(t)) for i, t in [*rows, *((1000 + i, t) for i, t in enumerate(TEXTS))]], key=repr)


def test_templates_by_diagonals(spark):
    got = {r["doc_id"]: r for r in L.scan(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "cc-by,cc-by-nc-4.0" and got[3]["labels"] == "gpl,gpl-3.0" and got[4]["labels"] == "gpl,gpl-3.0"
    assert got[6]["labels"] == "cc0" and got[6]["score"] >= 0.75 and got[6]["n_base"] == 0
    assert got[5]["labels"] == "gpl" and got[2]["n_base"] == 3
    assert [s["first"] for s in got[3]["spans"]] == [0]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[7]["score"] == 0


def test_repeated_rows_and_empty_table(spark, nothing):
    df = spark.createDataFrame([(1, TEXTS[6]), (1, TEXTS[6]), (1, "plain")], "doc_id long, text string")
    assert sorted(r["labels"] for r in L.scan(df).collect()) == ["", "cc0", "cc0"]
    assert L.scan(nothing).collect() == []


MIT = """Copyright (c) 2020 Jo Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright
notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS
PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
HEADER = """/* %s is free software: you can redistribute it and/or modify\n * it under the terms of the GNU %s License as published by
 * the Free Software Foundation, either version %s of the License, or\n * (at your option) any later version. */ int main;"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:\n * Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.\n * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.\n%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = "Neither the name of %s nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def test_many_phrases_and_joined_templates(spark, monkeypatch):
    """Any number of phrases; template grams above the broadcast bound are joined, with the same results."""
    phrases = [(f"phrase number {i} here", f"label{i:03d}") for i in range(100)]
    rows = [(i, f"x phrase number {i} here and phrase number {(i * 7) % 100} here; released under the mit license") for i in range(100)]
    df = spark.createDataFrame([(i, t, 5, "n") for i, t in rows], "row long, text string, hits int, tid string")
    got = {r["row"]: r for r in L.scan(df, id_col="row", phrases=phrases).collect()}
    assert all(got[i]["base_labels"] == ",".join(sorted({f"label{i:03d}", f"label{i * 7 % 100:03d}"})) and got[i]["n_base"] == 2 for i in got) and len(got) == 100
    assert all("mit-release" in r["labels"] for r in got.values())
    monkeypatch.setattr(L, "MAX_GRAMS", 3)
    again = {r["row"]: r for r in L.scan(df, id_col="row", phrases=phrases).collect()}
    assert again == got


def test_standard_bodies_and_headers(spark):
    want = [
        (MIT, "mit"), (MIT[:500], ""), (BSD % "", "bsd-2-clause"), (BSD % THIRD % "the copyright holder", "bsd-3-clause"), (BSD % THIRD % "Some Very Long Company of a Far Land", "bsd-3-clause"), (ISC, "isc"),
        (HEADER % ("Foo", "General Public", 3), "gpl,gpl-3.0"), (HEADER % ("This program", "General Public", 2), "gpl,gpl-2.0"), (HEADER % ("Foo", "Lesser General Public", "2.1"), "lgpl"), (HEADER % ("Foo", "Affero General Public", 3), "agpl"),
        ("You can use the software and share copies of it in any form, free of charge.", ""),
    ]
    got = {r["doc_id"]: r for r in L.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(len(want))] == [x for _, x in want]
    assert all(got[i]["score"] >= 0.75 for i, (_, x) in enumerate(want) if x)


def naive(text, templates, k=3, slack=2, least=0.75):
    """(labels of the method, best cover, spans) by lists of positions."""
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))
    t = words(text)
    spans = []
    for label, body in templates:
        b = words(body)
        at = {}
        for q in range(len(b) - k + 1):
            at.setdefault(tuple(b[q : q + k]), []).append(q)
        hits = sorted((p - q, p, q) for p in range(len(t) - k + 1) for q in at.get(tuple(t[p : p + k]), ()))
        bands = []
        for h in hits:
            if not bands or h[0] - bands[-1][-1][0] > slack:
                bands.append([])
            bands[-1].append(h)
        for band in bands:
            covered = {q + j for _, _, q in band for j in range(k)}
            first, last = min(p for _, p, _ in band), max(p for _, p, _ in band)
            if len(covered) / len(body.split()) >= least and last - first + k <= 2 * len(body.split()):
                spans.append((label, first, last + k - 1, len(covered) / len(body.split()), len(covered)))
    wins = lambda o, s: (o[4], o[3]) > (s[4], s[3]) and o[1] <= s[2] and s[1] <= o[2]
    return sorted(s for s in spans if not any(wins(o, s) for o in spans))


def test_labels_spans_and_scores_are_brute_force(spark):
    import random

    r = random.Random(9)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            w = r.choice(L.TEMPLATES[:17])[1].split()
            for _ in range(r.randrange(3)):
                i = r.randrange(len(w))
                w[i : i + r.randrange(2)] = r.choice([[], ["odd"], ["the", "very"]])
            parts.append(" ".join(w))
        texts.append(f"{r.choice(['', 'some words before', 'x '])} ".join(parts))
    texts += [MIT + " and then " + MIT, (BSD % THIRD % "ACME") + HEADER % ("Foo", "General Public", 3), None, "", "licensed"]
    got = {x["doc_id"]: x for x in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = naive(t, L.TEMPLATES)
        x = got[i]
        assert sorted((s["label"], s["first"], s["last"], round(s["cover"], 9), s["votes"]) for s in x["spans"]) == [(a, b, c, round(d, 9), e) for a, b, c, d, e in want], t
        base = [y for y in x["base_labels"].split(",") if y]
        assert x["labels"] == ",".join(sorted({*base, *(s[0] for s in want)}))
        assert x["score"] == (1.0 if base else max([s[3] for s in want], default=0.0))
