"""Phrase mining, ranked search and license scans against plain versions, and their edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_operators import ODD, prose, table

from quarry.llm import licenses, phrases, ranked
from quarry.llm import words as W


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_phrases(rows, least, top, longest=5):
    """Straight from the definition: every longer candidate of any length is looked at."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 100 * a for q, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), a, count[p[:k]], count[p[k:]], score))
        for rank, (_, _, p, a, left, right, score) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), a, left, right, n[lang], score))
    return out


def mined(docs, **kw):
    return {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in phrases.mine(docs, **kw).collect()}


def test_phrases(spark):
    rng = random.Random(41)
    line = "the quick brown fox jumps over"
    texts = [prose(rng, rng.randint(0, 40)) + rng.choice([f". {line}!", f"\t{line.upper()}  of it\r\nÄ ß", "", "the the the the the the"]) for _ in range(120)]
    rows = [(i, t, rng.choice(["en", "de", None, ""]), "s", 1) for i, t in enumerate(texts + texts[:20] + ODD[:5] + ODD[6:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as n", "'x' as piece", "2 as phrase")
    for least, top in ((4, 2000), (7, 9)):
        want = plain_phrases([(r[2], r[1]) for r in rows], least, top)
        assert want and mined(docs, least=least, top=top) == want
    assert phrases.mine(docs.limit(0)).count() == 0


def test_phrases_with_a_full_filter(spark, monkeypatch):
    """A filter that lets everything pass, and buckets that spill, change nothing."""
    rng = random.Random(42)
    docs = table(spark, [prose(rng, 60) for _ in range(80)])
    want = mined(docs, least=5)
    monkeypatch.setattr(phrases, "_filter", lambda frequent, k: np.full(1 << (phrases.FILTER_BITS - 3), 255, np.uint8))
    monkeypatch.setattr(phrases, "BATCH_PHRASES", 200)
    assert want and mined(docs, least=5) == want


def test_pieces():
    doc, piece, n = phrases.cut(*W.text_bytes(pa.array(["A  b\tC.d;;  ; e f", "", " . ", "Ä x\x0by"])))
    assert list(zip(doc.tolist(), piece.to_pylist(), n.tolist())) == [(0, "a b c", 3), (0, "d", 1), (0, "e f", 2), (3, "Ä x", 2), (3, "y", 1)]


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def plain_ranking(docs, items, top=20):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, all_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = set()
    for item, text in set(items):
        scores = []
        for doc, bag, n in bags:
            m = 75 + 25 * n * n_docs // all_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms_of(text) if bag[t])
            if s > 0:
                scores.append((-s, doc is None, doc))
        out |= {(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)}
    return out


def searched(docs, items, **kw):
    return {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranked.search(docs, items, **kw).collect()}


@pytest.mark.parametrize("block,step", [(1 << 21, 1 << 18), (150, 40)])
def test_ranked_search(spark, monkeypatch, block, step):
    rng = random.Random(51)
    monkeypatch.setattr(ranked, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(ranked, "STEP_NODES", step)
    texts = [prose(rng, rng.randint(0, 60)) + rng.choice(["", " Rare" + str(rng.randint(0, 9)), " Ünique"]) for _ in range(300)] + [t for t in ODD if len(t or "") < 9999]
    texts += texts[:30]  # equal scores
    rows = [(None if i == 17 else i, t) for i, t in enumerate(texts)]
    items = [(i, prose(rng, rng.randint(1, 25)) + f" rare{i}") for i in range(12)] + [(3, "alpha ALPHA alpha ünique"), (3, "alpha ALPHA alpha ünique"), (12, "no such terms"), (13, None), (14, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as rank", "3 as item_id").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    want = plain_ranking(rows, [x for x in items if x[1]])
    assert searched(docs, bench) == want
    monkeypatch.setattr(ranked, "ITEM_BYTES", 60)
    assert ranked.item_blocks.__defaults__ == (4 << 20,) and len(list(ranked.item_blocks(bench, 60))) > 3
    assert searched(docs.limit(0), bench) == set() and searched(docs, bench.limit(0)) == set()


def test_treaps_are_treaps():
    """Search order by document, heap order by steps of impact, also for documents sorted by impact; bounds hold for subtrees."""
    rng = np.random.default_rng(5)
    for impact in (np.sort(rng.integers(1, 999_999, 4000)), rng.integers(1, 999_999, 4000), np.full(4000, 7)):
        term = np.sort(rng.integers(0, 3, 4000))
        doc = np.concatenate([np.sort(rng.choice(9000, n, replace=False)) for n in np.bincount(term, minlength=3)])
        t = ranked.build(term, doc, impact, 4, 9000)
        seen, deepest, todo = [], 0, [(r, -1, 9000, 1 << 40, 1) for r in t.root if r]
        while todo:
            x, lo, hi, above, depth = todo.pop()
            seen.append(x)
            deepest = max(deepest, depth)
            assert lo < t.doc[x] < hi and t.impact[x] <= t.bound[x] <= above
            todo += [(y, a, b, t.bound[x], depth + 1) for y, a, b in ((t.left[x], lo, t.doc[x]), (t.right[x], t.doc[x], hi)) if y]
        assert len(seen) == len(set(seen)) == 4000 and t.root[3] == 0 and deepest < 400


def test_search_prunes():
    """Documents that cannot enter the top are not scored, the result is the same."""
    rng = np.random.default_rng(6)
    docs, items = 20_000, ranked.compile_items([0], ["common rare"])
    tf = rng.integers(1, 4, docs)
    some = np.sort(rng.choice(docs, 60, replace=False))
    term = np.concatenate([np.zeros(docs, np.int64), np.ones(60, np.int64)])
    impact = np.concatenate([tf * 1000, np.full(60, 900_000)])
    t = ranked.build(term, np.concatenate([np.arange(docs), some]), impact, 2, docs)
    best = ranked.Best(1, 20)
    scored = ranked.walk(t, items, np.array([5, 9000]), best, np.arange(docs), np.zeros(docs, bool))
    total = 5 * tf * 1000
    total[some] += 9000 * 900_000
    want = np.lexsort((np.arange(docs), -total))[:20]
    assert best.doc[0].tolist() == want.tolist() and best.score[0].tolist() == total[want].tolist() and scored < 2000


def test_lengths_beyond_64_bits():
    n = np.array([5, 10**9])
    assert ranked.lengths(n, 10**12, 10**14).tolist() == [75 + 25 * 5 * 10**12 // 10**14, 75 + 25 * 10**21 // 10**14]


LICENSE_TEXTS = [
    "Released under the MIT License.", "x under the mit license under THE Mit\nlicense y", "under the mit", "license", "Licensed under the Apache License, Version 2.0.", "apache license version 21",
    "Licensed under CC BY-NC 4.0.", "licensed under a the cc by nc", "This work is licensed under the GNU General Public License, version 3.",
    "licensed under the terms of the GNU general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "licensed under the gnu general public license version 2", "licensed under the gnu general public license as published version 3",
    re.sub("<<.*?>>", " ", licenses.TEMPLATES[10].text.replace("<<var;name=holders;words=1-8>>", "the authors")),
]


def plain_licenses(text, templates):
    """Every template at every word, by a backtracking reader of the markup."""
    w = terms_of(text)

    def ends(parts, at):
        if not parts:
            return {at}
        p, rest = parts[0], parts[1:]
        if isinstance(p, str):
            return ends(rest, at + 1) if at < len(w) and w[at] == p else set()
        if isinstance(p, list):
            return ends(rest, at) | {y for x in ends(p, at) for y in ends(rest, x)}
        return {y for k in range(p[0], p[1] + 1) if at + k <= len(w) for y in ends(rest, at + k)}

    return sorted((i, t.name, max(e) - 1) for t in templates for i in range(len(w)) if (e := ends(licenses.parse(t.text), i)))


def test_licenses(spark):
    rng = random.Random(61)
    words = "under the mit license apache version 2 cc by nc licensed released and terms of gnu general public 3 or any later a".split()
    texts = LICENSE_TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [" ".join(rng.choices(LICENSE_TEXTS[:11], k=4)) for _ in range(20)] + ODD
    out = {r["doc_id"]: r for r in licenses.scan(table(spark, texts, extra=True)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        if len(t or "") < 9999:
            assert sorted((m["first"], m["template"], m["last"]) for m in out[i]["matches"]) == plain_licenses(t, licenses.TEMPLATES), t
    rows = {r["doc_id"]: r for r in licenses.digest(licenses.scan(table(spark, texts))).collect()}
    assert (rows[1]["n_base"], rows[1]["first_word"], rows[1]["last_word"], rows[1]["base_labels"], rows[1]["labels"]) == (2, 1, 5, "mit", "mit")
    assert (rows[8]["n_base"], rows[8]["first_word"], rows[8]["base_labels"], rows[8]["labels"]) == (0, None, "", "gpl-3") and 0 < rows[8]["score"] < 1
    assert [rows[i]["labels"] for i in (2, 3, 5, 7, 10, 11)] == ["", "", "", "cc-by-nc", "", ""] and rows[2]["score"] == 0
    assert {m["template"] for m in out[12]["matches"]} == {"mit text"}  # with and without what is optional before it and rows[12]["score"] > 0.99
    assert licenses.scan(table(spark, ODD).limit(0)).count() == 0


def test_license_templates():
    T = licenses.Template
    with pytest.raises(ValueError):
        licenses.parse("a <<beginOptional>> b")
    with pytest.raises(ValueError):
        licenses.parse("a <<endOptional>>")
    with pytest.raises(ValueError):
        licenses.compile_templates([T("x", "x", "<<var;name=a;words=0-3>>")])
    some = [T("v", "v", "a <<var;name=z;words=1-3>> b <<beginOptional>>c <<beginOptional>>d<<endOptional>> e<<endOptional>>"), T("w", "w", "a a <<beginOptional>>a<<endOptional>> b"), T("u", "u", "x <<var;name=y;words=0-0>> y")]
    rng = random.Random(62)
    texts = [" ".join(rng.choice("aabcdexyz") for _ in range(30)) for _ in range(200)]
    w = W.find(*W.text_bytes(pa.array(texts)), W.ALNUM, True)
    for automata in (licenses.compile_templates(some), [licenses.compile_set([t]) for t in some]):
        got = defaultdict(list)
        for a in automata:
            for t, first, end in zip(*(x.tolist() for x in licenses.matches(a, w))):
                d = w.doc[first]
                got[d].append((int(first - w.first[d]), a.templates[t].name, int(end - 1 - w.first[d])))
        assert [sorted(got[i]) for i in range(len(texts))] == [plain_licenses(t, some) for t in texts]


def test_license_sets_are_halved(monkeypatch):
    whole = licenses.compile_templates(licenses.TEMPLATES)
    monkeypatch.setattr(licenses, "MAX_STATES", 400)
    parts = licenses.compile_templates(licenses.TEMPLATES)
    assert len(whole) == 1 and len(parts) > 1 and [t for a in parts for t in a.templates] == licenses.TEMPLATES
    monkeypatch.setattr(licenses, "MAX_STATES", 5)
    with pytest.raises(ValueError):
        licenses.compile_templates(licenses.TEMPLATES[-1:])
