"""The operators against brute force, and their edge cases."""

import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import decontam, html_text, langid, mixing, ngram_join, pii, quality, sharding, tokens, urls
from quarry.llm import words as W

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "a b c", "x" * 70_000, "wörter über äöü 日本語 text " * 40, "The same line here.\nThe same line here.\n" * 5, "The same line here.\nThe same line here.\n" * 5]


def table(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)], DOCS)
    return df.selectExpr("*", "1 as n", "'x' as kept", "2 as slot", "'y' as bucket") if extra else df


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + rng.choice(["", ".", "s"]) for _ in range(n))


def test_words():
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 50)) + rng.choice(["", "\n", " É ß"]) for _ in range(50)]
    w = W.find(*W.text_bytes(pa.array(texts)), W.ALNUM, True)
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        assert [w.text(k).decode() for k in range(w.first[i], w.first[i + 1])] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_hashes_of_long_ranges(monkeypatch):
    """Hashes do not depend on the piece that a range lies in, nor on the size of pieces."""
    rng = np.random.default_rng(22)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    data[rng.integers(0, 5000, 300)] = 32
    data[1000:3000] = 120  # one long word
    offsets = np.array([0, 40, 40, 700, 5000])
    want = W.find(data, offsets)
    assert len(set(zip(want.hash.tolist(), [want.text(k) for k in range(len(want.hash))]))) == len({want.text(k) for k in range(len(want.hash))})
    monkeypatch.setattr(W, "PIECE", 64)
    monkeypatch.setattr(W, "_powers", [])
    got = W.find(data, offsets)
    assert (got.hash == want.hash).all() and (got.start == want.start).all()


def test_very_long_text():
    """30 MB of words, of one word and of white space, with bounded memory."""
    import tracemalloc

    for unit in (b"some words that go on. ", b"x", b" \n"):
        data = np.frombuffer(unit * (30_000_000 // len(unit)), np.uint8)
        offsets = np.array([0, len(data)])
        tracemalloc.start()
        got = quality.measure(data, offsets)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got["n_words"][0] == len(unit.split()) * (30_000_000 // len(unit)) if unit != b"x" else got["n_words"][0] == 1
        assert peak < 45 * len(data)


def test_quality_features():
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 80)).replace(" mu", "\n") for _ in range(60)] + [t or "" for t in ODD]
    got = quality.measure(*W.text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        rep = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(w) < 2000 else None
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                dup += line in seen
                seen.add(line)
        assert (got["n_words"][i], got["n_chars_in_words"][i], got["n_dup_lines"][i]) == (len(w), sum(map(len, w)), dup)
        assert rep is None or got["n_repeat_words"][i] == len(rep)


def test_label_model():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.9
    votes = np.where(rng.random((4000, 6)) < np.where(good[:, None], 0.02, 0.4), -1, 1)
    pattern, counts = np.unique(votes, axis=0, return_counts=True)
    m = quality.fit(pattern, counts.astype(float))
    assert np.mean((m.posterior(votes) >= 0.5) == good) > 0.95


def test_quality_edges(spark):
    out = quality.judge(table(spark, ODD, extra=True)).collect()
    assert len(out) == len(ODD) and not any(r["kept"] for r in out if r["n_words"] < 10)
    assert quality.judge(table(spark, ODD).limit(0)).count() == 0


def brute_windows(texts, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in texts:
        w, hit, ids = low(t), set(), set()
        for i, x in items:
            b = low(x)
            n = min(13, len(b))
            for k in range(len(b) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == b[k : k + n]:
                        hit |= set(range(s, s + n))
                        ids.add(i)
        out.append((len(w), len(hit), sorted(ids)))
    return out


def test_decontamination():
    rng = random.Random(3)
    items = [(str(i), prose(rng, n)) for i, n in enumerate([1, 2, 5, 13, 20, 40, 0])]
    texts = [prose(rng, 30) + " " + rng.choice(items)[1].upper() + " " + prose(rng, 700) for _ in range(25)] + [t or "" for t in ODD if len(t or "") < 9999]
    p = decontam.compile_items([i for i, _ in items], [x for _, x in items])
    n, spans, ids = decontam.scan(*W.text_bytes(pa.array(texts)), [p])
    got = [(int(a), sum(s["last"] - s["first"] + 1 for s in b), c) for a, b, c in zip(n, spans, ids)]
    assert got == brute_windows(texts, items)


def test_decontamination_blocks(spark):
    """A benchmark in many blocks, held one at a time, gives what one block gives; hot ends of windows do not matter."""
    rng = random.Random(18)
    items = [(str(i), prose(rng, rng.randint(3, 40)) + " of the") for i in range(40)] + [("9999", " ".join(["of the"] * 9))]
    texts = [prose(rng, 60) + " " + rng.choice(items)[1] + " " + prose(rng, 40) for _ in range(60)] + ["of the " * 2000, None, "", "of the"] * 2
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = table(spark, texts, extra=True)
    got = [{r["doc_id"]: (r["n_words"], sum(s["last"] - s["first"] + 1 for s in r["spans"]), r["items"]) for r in decontam.decontaminate(docs, bench, block_bytes=b, carry=("kept",)).collect()} for b in (1 << 20, 300)]
    assert got[0] == got[1]
    few = [i for i, t in enumerate(texts) if len(t or "") < 2000]
    assert [got[0][i] for i in few] == brute_windows([texts[i] for i in few], items)
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "one"), (1, "one"), (None, "a b c"), (3, None)], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontam.digest(decontam.decontaminate(table(spark, ODD, extra=True), bench)).collect()}
    assert out[3]["contaminated"] and out[3]["n_items"] == 1 and out[0]["n_words"] == 0
    assert out[4]["contaminated"] and out[4]["n_hit"] == 3 and out[4]["n_items"] == 0  # of an item without item_id
    assert decontam.decontaminate(table(spark, ODD), bench.limit(0)).count() == len(ODD)


def test_decontamination_of_repetitive_texts():
    """One item and one text of one word each, and very many items with one window: within seconds and bounded memory."""
    import time
    import tracemalloc

    began = time.perf_counter()
    tracemalloc.start()
    p = decontam.compile_items(["1"], ["ab " * 5000])
    n, spans, ids = decontam.scan(*W.text_bytes(pa.array(["ab " * 1_000_000, "ab " * 12])), [p])
    assert list(n) == [1_000_000, 12] and spans == [[{"first": 0, "last": 999_999}], []] and ids == [["1"], []]
    p = decontam.compile_items([str(i) for i in range(100_000)], ["a b c d e f g h i j k l m"] * 100_000)
    n, spans, ids = decontam.scan(*W.text_bytes(pa.array(["x a b c d e f g h i j k l m y"] * 2)), [p])
    assert [len(x) for x in ids] == [100_000] * 2 and spans[0] == [{"first": 1, "last": 13}]
    assert time.perf_counter() - began < 60 and tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


def test_decontamination_with_equal_window_hashes(monkeypatch):
    """Windows with one hash are told apart by their bytes."""
    monkeypatch.setattr(decontam, "_window_keys", lambda w, h, start, length, block: np.zeros(len(start), np.uint64))
    rng = random.Random(31)
    items = [(str(i), prose(rng, n)) for i, n in enumerate([2, 13, 16, 16])]
    texts = [prose(rng, 5) + " " + rng.choice(items)[1] + " " + prose(rng, 9) for _ in range(9)]
    n, spans, ids = decontam.scan(*W.text_bytes(pa.array(texts)), [decontam.compile_items([i for i, _ in items], [x for _, x in items])])
    assert [(int(a), sum(s["last"] - s["first"] + 1 for s in b), c) for a, b, c in zip(n, spans, ids)] == brute_windows(texts, items)


def sets_of(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def brute_components(texts):
    s = [sets_of(t) for t in texts]
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and 175 * len(s[i] & s[j]) >= 75 * (len(s[i]) + len(s[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s[i]), find(i)) for i in range(len(s))]


def test_ngram_join(spark):
    rng = random.Random(4)
    texts = list(ODD)
    for size, edits in ((60, 12), (25, 4), (3, 1), (8, 30)):
        base = [f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(60, 160))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"v{rng.randint(0, 50)}"
            texts.append(" ".join(w))
    out = ngram_join.join(table(spark, texts, extra=True)).collect()
    want = brute_components(texts)
    assert [(r["n_shingles"], r["component_id"]) for r in sorted(out, key=lambda r: r["doc_id"])] == want


def test_ngram_join_dealt_lists(spark):
    """Lists that are dealt over tasks, and many long ones: the same components."""
    rng = random.Random(14)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    texts = []
    for _ in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 500)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:60] + [f"u{rng.randint(0, 99999)}" for _ in range(60)]) for _ in range(60)]  # a shared passage, unlike texts
    out = ngram_join.join(table(spark, texts), short_list=3, list_target=40).collect()
    assert [(r["n_shingles"], r["component_id"]) for r in sorted(out, key=lambda r: r["doc_id"])] == brute_components(texts)


def test_ngram_join_without_doc_id(spark):
    words = [f"w{i}" for i in range(100)]
    chain = [" ".join(words[:k]) for k in (100, 88, 74)]  # 1 - null - 3, linked only through the middle
    rows = [(1, chain[0]), (None, chain[1]), (None, chain[1]), (3, chain[2]), (None, "some other words that nobody else has"), (None, None), (4, ""), (4, "")]
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(chain)
    assert want[2][1] == 0 and len(sets_of(chain[0]) & sets_of(chain[2])) * 100 < 75 * len(sets_of(chain[0]) | sets_of(chain[2]))
    assert sorted(str((r["doc_id"], r["component_id"])) for r in out) == sorted(map(str, [(1, 1), (None, 1), (None, 1), (3, 1), (None, None), (None, None), (4, 4), (4, 4)]))
    assert ngram_join.join(table(spark, texts := ["a b c d e f"]).limit(0)).count() == 0 and texts


def test_sketch_counts():
    rng = np.random.default_rng(3)
    total, want = np.zeros(1 << 17, np.uint64), np.zeros(1 << 17, np.uint64)
    for dense in (True, False):
        own = np.zeros(1 << 17, np.uint32)
        at = rng.choice(len(own), 60_000 if dense else 50, False)
        own[at] = rng.integers(1, 300_000, len(at))
        want += own
        ngram_join.add_counts(total, ngram_join.pack_counts(own))
    assert (total == want).all()


def test_divide_skip():
    rng = np.random.default_rng(5)
    query = np.unique(rng.integers(0, 400, 120)).astype(np.uint64)
    block = [np.unique(np.concatenate([rng.permutation(query)[: rng.integers(1, len(query) + 1)], rng.integers(0, 400, rng.integers(0, 30)).astype(np.uint64)])) for _ in range(80)]
    want = [i for i, b in enumerate(block) if 175 * len(np.intersect1d(query, b)) >= 75 * (len(query) + len(b))]
    assert ngram_join.divide_skip(query, block).tolist() == want


def test_token_counts():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng = random.Random(6)
    alphabet = [" ", "  ", "\n", "\t", "'s", "'re", "'ll", "'", "''", "r", "abc", "é", "12", "!", "日本", "<|endoftext|>", "\x85", "’s", "😀", "'r", "Don't"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(500)] + ["", "y" * 3000, " " * 600 + "x"]
    path = P.path(tokens.TOKENIZER)
    want = [len(x) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert tokens.count_tokens(*W.text_bytes(pa.array(texts)), tokens.read_tokenizer(path)).tolist() == want


def test_counting_machine(monkeypatch):
    """Counts on transitions equal those of merging, piece by piece; the machine may begin anew at any time."""
    P = pytest.importorskip("public_tokenizers")
    merges = tokens.read_tokenizer(P.path(tokens.TOKENIZER))
    m, rng = tokens.machine(merges), random.Random(17)
    pieces = [b"".join(rng.choices(m.bytes, k=rng.randint(1, 6))) for _ in range(3000)] + [bytes(rng.choices(range(256), k=rng.randint(1, 40))) for _ in range(500)] + [b"a" * 700, b"-" * 900]
    data, at = np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    want = [len(m.encode(p)) for p in pieces]
    assert m.count(data, at[:-1], at[1:]).tolist() == want
    assert (m.emit < 0).any()  # a merge takes back what was counted
    m.keep(1)
    assert m.count(data, at[:-1], at[1:]).tolist() == want and m.count(data, at[:0], at[:0]).tolist() == []
    monkeypatch.setattr(tokens, "MAX_STATES", 3000)  # forgets again and again, inside long pieces too
    monkeypatch.setattr(tokens, "KEPT_STATES", 300)
    m.keep(1)
    monkeypatch.setattr(tokens, "BATCH", 2000)
    pieces += [bytes(rng.choices(b"etaoinshr", k=3000)) for _ in range(3)]
    data, at = np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    assert m.count(data, at[:-1], at[1:]).tolist() == [len(m.encode(p)) for p in pieces] and len(m.parts) <= 6000


def test_token_counts_spark(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = ODD + ["word " * 300_000, "x" * 200_000] + ODD
    out = tokens.token_counts(table(spark, texts, extra=True), P.path(tokens.TOKENIZER)).collect()
    want = [len(x) for x in Tokenizer.from_file(P.path(tokens.TOKENIZER)).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in sorted(out, key=lambda r: r["doc_id"])] == [(len((t or "").encode()), n, n > 512) for t, n in zip(texts, want)]
    assert tokens.token_counts(table(spark, texts).limit(0), P.path(tokens.TOKENIZER)).count() == 0


def test_scan_of_maps():
    rng = np.random.default_rng(7)
    maps, out, at = rng.integers(0, 12, (37, 12)).astype(np.uint8), tokens.compose_scan, np.arange(12)
    scanned = out(maps)
    for i in range(37):
        at = maps[i][at]
        assert (scanned[i] == at).all()


def test_html():
    x = html_text.extract
    assert x("<body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>a <b>b</b>\n c<p>d</article><footer>f</footer>") == "T & U\na b c\nd"
    assert x('<article><p>x</p><div class="comments"><p>no</p></div></article><aside>no</aside><script>no</script>') == "x"
    assert x(None) == x("") == x("<!-- open <p>x") == ""
    assert x("<article><p>1 < 2 &amp;lt; 3<br>4</p><p unfinished") == "1 < 2 &lt; 3 4"


def plain_main_text(page):
    """The article of a well-formed page by the standard library's parser: what stands in article or main, without furniture."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.lines, self.now = [], [], []

        def cut(self):
            text = " ".join("".join(self.now).split())
            self.now = []
            if text:
                self.lines.append(text)

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.now.append(" ")
            if tag in html_text.BLOCK:
                self.cut()
            if tag not in html_text.VOID:
                self.stack.append((tag, dict(attrs).get("class") or ""))

        def handle_endtag(self, tag):
            if tag in html_text.BLOCK:
                self.cut()
            if any(t == tag for t, _ in self.stack):
                while self.stack.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            tags = {t for t, _ in self.stack}
            if tags & {"article", "main"} and not tags & {"nav", "aside", "footer", "form", "script", "style"} and not {c for _, c in self.stack} & {"comments", "ad", "newsletter"}:
                self.now.append(data)

    reader = Reader()
    reader.feed(page or "")
    reader.close()
    reader.cut()
    return "\n".join(reader.lines)


def test_html_plain(spark):
    """Generated pages with every kind of furniture, through Spark, against a plain reader."""
    rng = random.Random(15)
    para = lambda: "<p>" + prose(rng, rng.randint(1, 60)).replace("mu", "<b>m</b>u &amp; &#233;", 1) + "</p>"
    menu = "<nav><ul>" + "".join(f"<li><a href=/{i}>{prose(rng, 2)}</a></li>" for i in range(5)) + "</ul></nav>"
    pages_ = []
    for i in range(120):
        body = [f"<h1>{prose(rng, 5)}</h1>", *(para() for _ in range(rng.randint(1, 9)))]
        for extra in rng.sample(['<div class="ad">' + para() + "</div>", '<div class="newsletter">' + para() + "</div>", "<aside>" + para() + "</aside>", "<form>" + para() + "</form>", "<script src=https://x.com/>var a = '<p>no</p>'</script>", "<ul><li>one of</li><li>two of</li></ul>", '<section class="warning-signs">' + "<p>" + prose(rng, 50) + "</p></section>"], rng.randint(0, 4)):
            body.insert(rng.randint(1, len(body)), extra)
        text = "".join(body) + ('<div class="comments">' + para() + para() + "</div>" if i % 3 == 0 else "")
        pages_.append(f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{menu}<article>{text}</article>" + ("<aside>" + para() * 3 + "</aside>" if i % 2 else "") + "<footer><p>All rights of " + prose(rng, 4) + "</p></footer></body></html>")
    rows = [(i, f"u{i}", p) for i, p in enumerate(pages_)] + [(900, None, None), (901, "u", ""), (0, "u0", pages_[0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = html_text.main_text(df).collect()
    want = {i: plain_main_text(p) for i, p in enumerate(pages_)} | {900: "", 901: ""}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    alike = [r["text"] == want[r["page_id"]] for r in got]
    lines = [(len(set(r["text"].split("\n")) & set(want[r["page_id"]].split("\n"))), len(set(r["text"].split("\n")) | set(want[r["page_id"]].split("\n")))) for r in got]
    assert sum(alike) >= 0.95 * len(alike) and sum(a for a, _ in lines) >= 0.99 * sum(b for _, b in lines)
    assert html_text.main_text(df.limit(0)).count() == 0


def test_html_edges():
    x, words = html_text.extract, lambda n: "<p>" + " ".join(["word"] * n) + "</p>"
    assert x("<article><p>a b</p><script src=https://x.com/>var leak=1</script><p>c &<b>amp;</b> d</p></article>") == "a b\nc &amp; d"
    assert len(x(f'<body><nav><a href=/>x</a></nav><div class="share-price">{words(60)}</div>').split()) == 60
    assert len(x(f'<article><p>hello there</p><section class="warning-signs">{words(60)}</section></article>').split()) == 62
    for name in ("reader-comments", "userComments", "comment-thread", "legal-notice", "google-ad", "sidebar", "site-newsletter", "cookie-banner"):
        assert x(f'<article>{words(30)}<div class="{name}">{words(45)}{words(8)}</div>{words(12)}</article>').count("word") == 42, name
    for name in ("cookiebar", "gdprBox", "commentsection", "newsletterform"):  # written as one word
        assert x(f'<article>{words(30)}<div class="{name}">{words(45)}{words(8)}</div>{words(12)}</article>').count("word") == 42, name
    for name in ("adaptation", "commentary", "formation", "shareholders"):
        assert x(f'<article>{words(30)}<div class="{name}">{words(45)}{words(8)}</div>{words(12)}</article>').count("word") == 95, name
    wrapped = f"<nav><a href=/>x</a></nav><article>{words(5)}{words(40)}</article><footer>c</footer>"
    assert x(f"<body><form id=aspnetForm>{wrapped}</form>") == x(f"<body>{wrapped}") and len(x(f"<body><form id=f><div>{words(50)}{words(40)}</div></form>").split()) == 90
    assert x("<article><p title=it's>a b c</p><p>d n's e</p></article>") == "a b c\nd n's e"
    assert x("""<article><p title="a > b" x='c > d' y = "e">a b</p><p "stray>c</p></article>""") == "a b\nc"
    assert x('<article><p a="b>c d</p>' + '<p a="' * 50_000) == "c d"
    assert x('<article><p>a b</p><p class="hidden-gem">c d</p><p title="hidden">e f</p><p hidden>g</p><p style="display: none">h</p></article>') == "a b\nc d\ne f"
    assert x("<div>" * 40_000 + "</ul>" * 40_000 + words(30)) == " ".join(["word"] * 30)
    assert len(x("<article>" + words(500_000) + "</article>")) == 5 * 500_000 - 1


def test_urls_lists(spark, monkeypatch):
    """Several arrays, equal digests, null and repeated rules, other columns, an empty table."""
    rng = random.Random(16)
    rules = [(f"h{rng.randint(0, 400)}.{rng.choice(['net', 'org'])}/{rng.choice(['', 'a/', 'a/b/'])}", rng.choice(["block", "allow"])) for _ in range(300)] + [(None, "block"), ("net/", "block"), ("net/", "allow")]
    rows = [(i, f"http://{rng.choice(['', 'www.'])}H{rng.randint(0, 400)}.{rng.choice(['net', 'org'])}/{rng.choice(['', 'a/x', 'a/b/c?d'])}") for i in range(500)] * 2
    first = {}
    for k, v in sorted(r for r in rules if r[0]):
        first.setdefault(k, v)

    def plain(url):
        host, _, path = url.partition("://")[2].partition("/")
        host, path = host.lower(), "/" + path.split("?")[0]
        fits = [k for k in first if (host == k[: k.index("/")] or host.endswith("." + k[: k.index("/")])) and path.startswith(k[k.index("/") :])]
        best = min(fits, key=lambda k: (-len(k), k), default=None)
        return best, first.get(best, "allow")

    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rule", "'z' as verdict")
    for most in (1 << 20, 2000):
        monkeypatch.setattr(urls, "MAX_LIST_BYTES", most)
        got = urls.judge(df, rules).collect()
        assert len(got) == len(rows) and all((r["rule"], r["verdict"]) == plain(rows[r["page_id"]][1]) for r in got)
    assert urls.judge(df.limit(0), rules).count() == 0
    long = [(0, "x://" + "a." * 1_000_000 + "h1.net/a/b/c"), (1, "x://" + "." * 1_000_000), (2, "x://net/" + "p" * 1_000_000)]  # hosts of very many labels
    got = urls.judge(spark.createDataFrame(long, "page_id long, url string"), [("h1.net/a/", "block"), ("net/p", "block")]).select("page_id", "rule").orderBy("page_id").collect()
    assert [r["rule"] for r in got] == ["h1.net/a/", None, "net/p"]


def test_shared_folder_is_asked_for():
    """Off one machine the session must name the folder that driver and executors share."""
    from types import SimpleNamespace as N

    from quarry.llm import cluster

    session = lambda master, named: N(conf=N(get=lambda k, d: named), sparkContext=N(master=master, getConf=lambda: {}, _quarry_own_dir=None))
    assert cluster.shared_dir(session("spark://h:7077", "hdfs://x/y/")) == "hdfs://x/y" and cluster.shared_dir(session("local[2]", None)).startswith("file:///")
    with pytest.raises(RuntimeError):
        cluster.shared_dir(session("spark://h:7077", None))


def test_urls_equal_digests(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda x: len(x) % 3)
    keys = [(f"k{i}" * (i % 4 + 1), "block") for i in range(30)]
    urls.build(keys, tmp_path, "l")
    found = urls.DigestArray(*(str(tmp_path / f"l.{e}") for e in ("keys", "at", "text")))
    assert found.find([k.encode() for k, _ in keys] + [b"nothing", b"k"]) == ["block"] * 30 + [None, None]


def test_urls(spark):
    rows = [(1, "https://a.Example.NET/en/x?q"), (2, "http://b.net/de/"), (3, "http://example.com/de/1#t"), (4, "https://x.org/fr/"), (5, None), (6, "no scheme"), (7, "http://net?x"), (8, "http://notexample.com/de/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.RULES).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("net/", "block") and got[3][2:] == ("example.com/de/", "block")
    assert got[4][2:] == ("org/fr/", "allow") and got[5] == got[6] == ("", "", None, "allow") and got[7] == ("net", "", None, "allow") and got[8][2:] == (None, "allow")


def test_language(spark):
    rng = random.Random(8)
    voice = {"aa": "kalo mira tenu sopa", "bb": "xyz qrst wvu zzk", "cc": "жил был кот дом"}
    rows = [(i, " ".join(rng.choices(voice[g].split(), k=12)), g, "s", 0) for i, g in enumerate(rng.choices(list(voice), k=300))] + [(900, None, None, None, 0), (901, "12 34 !!", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(*langid.sample(docs))).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2 and r[2]]
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.95
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0
    assert langid.identify(docs, langid.train([], [])).first()["lang_pred"] == "und"


def test_language_rare(spark):
    """Many languages, rare ones too, in shares; whole texts beyond their share of bytes are not learned from."""
    rng = random.Random(19)
    rows, n = [], 0
    for k in range(30):
        voice = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz" if k % 2 else "абвгдежзиклмнопрстуфхцч", k=4)) for _ in range(5)]
        for _ in range(400 if k == 0 else 12):
            n += 1
            rows.append((n, " ".join(rng.choices(voice, k=20)), f"l{k:02}", "s", 0))
    docs = spark.createDataFrame(rows + rows[:5] + [(5000, "x" * 400_000, "l99", "s", 0)], DOCS).selectExpr("*", "1 as lang_pred", "2 as score")
    texts, langs = langid.sample(docs, 90, 300_000)
    assert len(set(langs)) == 30 and max(map(langs.count, langs)) == 2 and max(map(len, texts)) < 1000
    model = langid.train(*langid.sample(docs))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in rows]) > 0.97 and len(got) == len(rows) + 1
    unknown = langid.identify(spark.createDataFrame([(1, "日本語", None, None, 0)], DOCS), model).first()
    assert (unknown["lang_pred"], unknown["score"]) == ("l00", 0.0)
    assert langid.identify(docs.limit(0), model).count() == 0


def test_language_kernel():
    """Scores equal the kernel written out: shared grams over the root of both numbers of grams."""
    rng = random.Random(20)
    texts = [prose(rng, rng.randint(1, 30)) for _ in range(40)]
    grams = [{t[i : i + n] for t in [re.sub(r"[^a-z]+", " ", t)] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    slot, doc, _ = langid.presence(*W.text_bytes(pa.array(texts, pa.large_string())))
    assert np.bincount(doc, minlength=40).tolist() == list(map(len, grams))
    column = np.full(1 << langid.SLOTS, -1, np.int32)
    column[np.unique(slot)] = np.arange(len(np.unique(slot)))
    marks = np.zeros((len(np.unique(slot)), 40))
    marks[column[slot], doc] = (1 / np.sqrt(np.bincount(doc)))[doc]
    got = langid.Model(["a"], column, marks).product(slot, doc, 40)[0]
    want = [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in grams] for a in grams]
    assert np.allclose(got, want)


def test_sharding(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(400)] + ["the same text"] * 150 + ODD[:5]
    out = sharding.shard(table(spark, texts, extra=True)).toPandas()
    assert len(out) == len(texts) and set(out["shard"]) == set(range(8))
    size = out.groupby("shard")["size"].sum()
    assert size.max() / size.mean() < 1.06
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in out.itertuples())
    assert sharding.shard(table(spark, texts).limit(0)).count() == 0


def test_sharding_equal_rows(spark):
    """Rows that nothing tells apart are still dealt evenly, and a tree may have any number of leaves."""
    for rows in ([(None, "same", "en", "s", 1)] * 400, [(7, "same", "en", "s", 1)] * 400):
        out = sharding.shard(spark.createDataFrame(rows, DOCS)).toPandas()
        assert out.groupby("shard").size().tolist() == [50] * 8
        assert all(sorted(g["slot"]) == list(range(50)) for _, g in out.groupby("shard"))
    rng = random.Random(10)
    docs = table(spark, [prose(rng, rng.randint(1, 60)) for _ in range(700)])
    total = sum(r["size"] for r in sharding.metadata(docs).collect())
    size = sharding.shard(docs, target_bytes=total // 11 + 1).toPandas().groupby("shard")["size"].sum()
    assert len(size) == 11 and size.max() / size.mean() < 1.1


def test_mixing(spark):
    rows = [(i, "t", "en", s, 1) for i, s in enumerate(["a"] * 600 + ["b"] * 250 + [None] * 90 + [""] * 60)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.schedule(docs, block_rows=10).toPandas()
    assert len(out) == len(rows) and ((out.q_release <= out.q_slot) & (out.q_slot < out.q_deadline)).all()
    mixed = mixing.mix(docs.selectExpr("*", "0 as q_x"))
    assert mixed.count() == len(rows) and mixed.columns[-1] == "q_x"
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_pfair_deviation(seed):
    """Against the weights as given, for any number of slots."""
    rng = random.Random(seed)
    if seed == 0:
        weights = {"a": 0.9, "b": 0.0995, "c": 0.0005}
    else:
        weights = {str(i): rng.random() ** 3 + 1e-4 for i in range([3, 9, 40, 1000, 2][seed - 1])}
    total = sum(map(Fraction, weights.values()))
    share = {s: Fraction(w) / total for s, w in weights.items()}
    slots = 20_000 if len(weights) < 1000 else 3000
    placed, last = dict.fromkeys(weights, 0), -1
    for name, i, slot, release, deadline in mixing.earliest_deadline_first(weights, dict.fromkeys(weights, 10**9)):
        if slot >= slots:
            break
        assert slot == last + 1 and release <= slot < deadline and i == placed[name]
        placed[name], last = i + 1, slot
        if len(weights) < 1000 or slot % 97 == 0:
            assert all(abs(placed[s] - w * (slot + 1)) < 1 for s, w in share.items())
    assert all(abs(placed[s] - w * slots) < 1 for s, w in share.items())


def test_pfair_sources_that_run_out():
    rows = list(mixing.earliest_deadline_first({"a": 1, "b": 1, None: 2}, {"a": 2, "b": 40, None: 5}))
    assert len(rows) == 47 and len({r[2] for r in rows}) == 47 and all(r[3] <= r[2] < r[4] for r in rows)
    assert list(mixing.earliest_deadline_first({}, {})) == []


def test_mixing_edges(spark):
    rows = [(None if i % 3 else i, None if i % 2 else "t", "en", "s", 1) for i in range(200)] * 2
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as q_slot", "2 as q_index", "3 as q_k")
    out = mixing.schedule(spark.createDataFrame(rows, DOCS), block_rows=8).toPandas()
    assert sorted(zip(out.q_slot, out.q_place)) == [(i, j) for i in range(50) for j in range(8)]
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, docs.collect()))
    with pytest.raises(ValueError):
        mixing.schedule(docs, {"other": 1.0})


def test_pii(spark):
    rows = [(1, "Mail Anna.B@Mail.example.com or anna.b@mail.example.com, +1 (743) 555-3824 or +1-743-555-3824."), (2, "Frau Anna Schmidt paid with 4539 1488 0343 6467 or 4539148803436467 from 10.2.3.4"), (3, None), (4, "nothing 12 here"), (None, "x@y.org"), (4, "x@y.org")]
    got = {(r["doc_id"], i): r for i, r in enumerate(pii.scrub(spark.createDataFrame(rows, "doc_id long, text string")).collect())}
    by = {}
    for (d, _), r in got.items():
        by.setdefault(d, []).append(r["text"])
    one = by[1][0]
    mails = re.findall(r"\S+@\S+\.com", one)
    assert mails[0].lower() == mails[1] and "anna" not in one.lower() and "743" not in one
    phones = [re.sub(r"\D", "", p) for p in re.findall(r"\+1[ \d()-]+", one)]
    assert phones[0] == phones[1]
    cards = [re.sub(" ", "", c) for c in re.findall(r"4\d{3} ?\d{4} ?\d{4} ?\d{4}", by[2][0])]
    luhn = lambda n: sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(n))) % 10
    assert cards[0] == cards[1] != "4539148803436467" and luhn(cards[0]) == luhn("4539148803436467")
    assert by[2][0].startswith("Frau ") and by[2][0].split()[1] in pii.NAMES["latin"]["f"] and "Schmidt" not in by[2][0]
    assert by[3] == [None] and "nothing 12 here" in by[4] and by[None][0] in by[4]


def test_equal_digests_of_different_sets(spark, monkeypatch):
    rows = lambda *r: spark.createDataFrame(r, "n long, cls long, chk long")
    assert not ngram_join.clash(rows((2, 5, 6), (2, 5, 6), (3, 7, 6)))
    assert ngram_join.clash(rows((2, 5, 6), (2, 5, 7))) and ngram_join.clash(rows((2, 5, 6), (3, 5, 6)))
    h, at = np.arange(9, dtype=np.uint64), np.array([0, 4, 9])
    assert not set(np.concatenate(ngram_join.classes(h, at))) & set(np.concatenate(ngram_join.classes(h, at, 1)))
    turns = iter([True, False])
    monkeypatch.setattr(ngram_join, "clash", lambda rows: next(turns))
    rng = random.Random(13)
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(40)]
    texts += [t + " one more" for t in texts[:20]] + texts[:5]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute_components(texts)] and next(turns, None) is None


def test_pii_coreference(spark):
    """A surname has one surrogate, alone or with a given name; addresses of one domain keep it in common."""
    texts = ["Frau Anna Schmidt came. Frau Schmidt left. Herr Schmidt and Paul Schmidt too. Мария Иванова, Frau Zora Schmidt.", "a@one.org b@one.org a@two.org", "10.1.1.1 192.168.0.9 172.20.1.1 8.8.8.8"]
    got = {r["doc_id"]: r["text"] for r in pii.scrub(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    m = re.fullmatch(r"Frau (\w+) (\w+) came. Frau (\w+) left. Herr (\w+) and (\w+) (\w+) too. (\w+) (\w+), Frau (\w+) (\w+).", got[0])
    assert len({m[2], m[3], m[4], m[6], m[10]}) == 1 and m[2] != "Schmidt" and len({m[1], m[5], m[9]}) == 3
    assert m[1] in pii.NAMES["latin"]["f"] and m[5] in pii.NAMES["latin"]["m"] and m[7] in pii.NAMES["cyrillic"]["f"] and m[9].endswith("a")
    a, b, c = got[1].split()
    assert a.split("@")[1] == b.split("@")[1] != c.split("@")[1] and len({a, b, c}) == 3 and not {a, b, c} & set(texts[1].split())
    ips = got[2].split()
    assert ips[0].startswith("10.") and ips[1].startswith("192.168.") and re.match(r"172\.(1[6-9]|2\d|3[01])\.", ips[2]) and not re.match(r"10\.|192\.168|172", ips[3])


def test_pii_whole_names(spark):
    """Capitals, apostrophes and hyphens inside names: nothing of a name stays, and the same name has the same surrogate."""
    names = ["Frau McDonald", "Anna Schmidt-Meier", "John O'Brien", "Mr. O’Neill-MacArthur", "Herr Peter D'Angelo", "Mme Durand"]
    texts = [f"Es schrieb {n}, und {n} kam." for n in names] + ["Herr Peter sagte: Anna war da."]
    out = {r["doc_id"]: r for r in pii.scrub(table(spark, texts)).collect()}
    for i, n in enumerate(names):
        text = out[i]["text"]
        left = [p for p in re.split(r"[^\w]+", n) if len(p) > 2 and p not in ("Frau", "Herr", "Mme") and p in text]
        assert not left, (n, text)
        one, two = re.fullmatch(r"Es schrieb (.*), und (.*) kam\.", text).groups()
        assert one == two and len(one.split()) == len(n.split())


def test_pii_few_values(spark):
    """A format with too few values gives longer surrogates instead of none."""
    mails = [f"{c}@q.org" for c in "abcdefghijklmnopqrstuvwxyz"]
    got = pii.scrub(spark.createDataFrame([(1, " ".join(mails))], "doc_id long, text string")).first()
    assert got["n_entities"] == 26 and len(set(got["text"].split())) == 26 and not set(got["text"].split()) & set(mails)


N = 10**6
LONG = {
    "labels": "x@" + "a." * (N // 2), "dots": "a." * (N // 2), "ats": "a@" * (N // 2), "ones": "1" * N, "spaced": "1 " * (N // 2), "hex": "0123456789abcdef" * (N // 16), "ibans": "AB12 " * (N // 5),
    "quads": "1.2.3.4." * (N // 8), "names": "Anna " * (N // 5), "titles": "Frau Anna " * (N // 10), "quotes": "'" * N, "mailbox": "a" * N + "@x.org", "label": "x@" + "b" * N + ".org", "phones": "+1 22 33 " * (N // 9),
    "parens": "(22)" * (N // 4), "secret": "token='" + "z" * N + "'",
}


def test_pii_long_texts(spark):
    docs = spark.createDataFrame(list(enumerate(LONG.values())), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.scrub(docs).collect()}
    assert len(got) == len(LONG)
    names = dict(enumerate(LONG))
    kinds = {names[i]: r["kinds"] for i, r in got.items()}
    assert kinds["hex"] == kinds["secret"] == kinds["ones"] == ["secret"] and kinds["mailbox"] == ["email"] and kinds["names"] == ["person"] and kinds["labels"] == []
    assert all(r["text"] != LONG[names[i]] for i, r in got.items() if r["kinds"])


def test_pii_is_one_to_one(spark):
    """Over many texts every entity has one surrogate wherever it stands, no two share one, and formats stay."""
    rng = random.Random(23)
    luhn = lambda n: sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(n))) % 10
    pool = [f"{a}.{b}@{c}.{d}" for a in ("ann", "bob", "eve") for b in ("x", "lee", "kim") for c in ("mail", "corp") for d in ("org", "com")]
    pool += [f"+49 {rng.randint(100, 999)} {rng.randint(1000, 9999)}" for _ in range(30)] + [f"{rng.randint(1, 223)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 254)}" for _ in range(30)]
    pool += [f"4{rng.randint(10**14, 10**15 - 1)}" for _ in range(30)] + [f"{rng.randint(100, 899)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}" for _ in range(30)]
    pool = sorted(set(pool))
    texts = [" | ".join(rng.choices(pool, k=rng.randint(1, 6))) for _ in range(300)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as kinds", "1 as n_entities", "2 as hash")
    got = pii.scrub(df).collect()
    assert len(got) == len(rows)
    named = {r["doc_id"]: r["text"] for r in got if r["doc_id"] is not None}
    new = {}
    for i, t in enumerate(texts):
        if i % 7:
            for a, b in zip(t.split(" | "), named[i].split(" | "), strict=True):
                assert new.setdefault(a, b) == b
    assert len(set(new.values())) == len(new) > 100 and not set(new) & set(new.values())
    for a, b in new.items():
        if "." in a and "@" not in a:
            assert all(0 <= int(x) <= 255 for x in b.split("."))
        else:
            assert re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "0", a)) == re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "0", b))
        if len(a) == 16 and a.isdigit():
            assert luhn(a) == luhn(b) and a[0] == b[0]
    assert sorted(map(str, [r["text"] for r in got if r["doc_id"] == 1])) == [named[1]] * 2
    assert pii.scrub(df.limit(0)).count() == 0


def test_mixing_plain(spark):
    """Slots as a plain scheduler gives them that looks at every source's next block at every slot."""
    rng = random.Random(24)
    counts = {None: 130, "": 40, "a": 700, "b": 33, "c": 260}
    weights = {s: rng.random() + 0.05 for s in counts}
    rows = [(i, "t", "en", s, 1) for i, s in enumerate([s for s, n in counts.items() for _ in range(n)])]
    total = sum(map(Fraction, weights.values()))
    left = {s: -(-n // 16) for s, n in counts.items()}
    placed, want, slot = dict.fromkeys(counts, 0), {}, 0
    while any(placed[s] < left[s] for s in counts):
        due = []
        for s in sorted(counts, key=lambda s: (s is not None, s)):
            share, i = Fraction(weights[s]) / total, placed[s]
            if i < left[s] and slot >= i / share // 1:
                due.append((-(-(i + 1) / share // 1), len(due), s))
        if due:
            s = min(due, key=lambda d: d[:2])[2]
            want[s, placed[s]] = slot
            placed[s] += 1
        slot += 1
    out = mixing.schedule(spark.createDataFrame(rows, DOCS), weights, block_rows=16).toPandas()
    got = {(None if s is None or s != s else s, b): x for s, b, x in zip(out.source, out.q_block, out.q_slot)}
    assert got == want
    assert sorted(out.q_before + out.q_place) == list(range(len(rows)))


def test_sharding_is_a_tree_of_cuts(spark):
    """Between the halves of every node lies one cut of one dimension, and halves weigh what they should."""
    rng = random.Random(25)
    texts = [prose(rng, rng.randint(1, 200)).replace("mu", "\n").replace("xi", "日本") for _ in range(900)] + ["the same text"] * 300
    docs = table(spark, texts)
    meta = {r["doc_id"]: r for r in sharding.metadata(docs).collect()}
    shard = {r["doc_id"]: (r["shard"], r["size"]) for r in sharding.shard(docs).collect()}
    whole = sum(n for _, n in shard.values())
    for low, high in (((0, 4), (4, 8)), ((0, 2), (2, 4)), ((4, 6), (6, 8)), ((0, 1), (1, 2)), ((2, 3), (3, 4)), ((4, 5), (5, 6)), ((6, 7), (7, 8))):
        a, b = ([meta[i] for i, (s, _) in shard.items() if lo <= s < hi] for lo, hi in (low, high))
        key = lambda d: lambda r: (r[d], r["text_hash"], r["row_hash"], r["row_no"])
        assert any(max(map(key(d), a)) < min(map(key(d), b)) for d in sharding.DIMS)
        assert abs(sum(r["size"] for r in a) - sum(r["size"] for r in b)) < 0.03 * whole / 8 * (low[1] - low[0] + 1)


def test_language_of_a_very_long_text(spark):
    rows = [(i, " ".join(random.Random(i).choices(["kalo mira tenu", "xyz qrst wvu"][i % 2].split(), k=15)), "ab"[i % 2], "s", 0) for i in range(80)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.train(*langid.sample(docs))
    long = spark.createDataFrame([(1, "kalo mira tenu " * 200_000, None, None, 0), (2, "1 2 3 " * 300_000, None, None, 0)], DOCS)
    assert [r["lang_pred"] for r in langid.identify(long, model).orderBy("doc_id").collect()] == ["a", "und"]
