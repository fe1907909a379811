"""The pipeline against a plain version of its stages on a small table."""

import random
import re

import corpus_pipeline
from quarry.llm import mixing, quality


def words(t, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def least_of_groups(docs):
    ids, s, root = sorted(docs), {d: shingles(t) for d, t in docs.items()}, {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if s[a] and 175 * len(s[a] & s[b]) >= 75 * (len(s[a]) + len(s[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in ids if find(d) == d}


def contaminated(t, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, hit = words(t, pattern), set()
    for x in items:
        b = words(x, pattern)
        n = min(13, len(b))
        for k in range(len(b) - n + 1):
            for s in range(len(w) - n + 1):
                if w[s : s + n] == b[k : k + n]:
                    hit |= set(range(s, s + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in ("an", "el", "or", "um") for c in ("a", "ed", "ing", "s", "")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    items = [prose(30) for _ in range(3)]
    texts = [prose(rng.randint(50, 90)) for _ in range(80)]
    texts += [texts[3], texts[3], texts[4] + " extra words", re.sub(r"^\S+ \S+", "two others", texts[5])]
    texts += [prose(40) + " " + items[0] + " " + prose(20), prose(900) + " " + items[1], items[2].upper()]
    texts += ["### %%% $$$ " * 30, "short one", "", None, "same again and again " * 30]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r["doc_id"]: texts[r["doc_id"]] for r in quality.judge(docs).where("kept").collect()}
    assert set(range(80)) <= set(kept) and not {len(texts) - k for k in (1, 2, 3, 4, 5)} & set(kept)
    left = least_of_groups(kept)
    want = {d for d in left if not contaminated(texts[d], items)}
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(out["doc_id"]) == sorted(want) and len(want) < len(left) < len(kept)
    assert set(out["shard"]) == set(range(8))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def plain_features(t):
    """What the nine rules look at, word by word."""
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    letters = [c for c in t or "" if c.lower() in LETTERS and c.isascii()]
    return {
        "words": len(w), "chars": sum(map(len, w)), "symbols": sum((t or "").count(c) for c in "#*$%&|<>"),
        "dup": sum(x in lines[:i] for i, x in enumerate(lines)), "repeat": len({i + k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(5)}),
        "lines": len(lines), "ended": sum(re.split(r"[\x20\x09-\x0D]+", x.rstrip(" \t\x0b\x0c\r"))[-1][-1] in ".!?:;\"')" for x in lines),
        "letters": len(letters), "upper": sum(c.isupper() for c in letters), "alpha": sum(any(c.lower() in LETTERS or ord(c) > 127 for c in x) for x in w),
    }


def plain_verdicts(texts):
    """kept of each text: votes by ratios, EM text by text, in plain loops."""
    import math

    def vote(over, under, good, *bad):
        if not under:
            return 0
        x = over / under
        return -1 if any(a <= x < b for a, b in bad) else 1 if good[0] <= x < good[1] else 0

    inf, fs, votes = math.inf, [plain_features(t) for t in texts], []
    for f in fs:
        votes.append([
            vote(f["words"], 1, (40, inf), (0, 15)), vote(f["chars"], f["words"], (3, 9), (0, 2.2), (14, inf)), vote(f["symbols"], f["words"], (0, 0.05), (0.3, inf)),
            vote(f["symbols"], f["chars"], (0, 0.02), (0.1, inf)), vote(f["dup"], f["lines"], (0, 0.1), (0.34, inf)), vote(f["repeat"], f["words"], (0, 0.05), (0.18, inf)),
            vote(f["upper"], f["letters"], (0, 0.2), (0.5, inf)), vote(f["alpha"], f["words"], (0.85, inf), (0, 0.7)), vote(f["ended"], f["lines"], (0.5, inf), (0, 0.1)),
        ])
    start, weight = (0.35, 0.01), 50
    given, prior = [[start[0]] * 9, [start[1]] * 9], 0.85
    for _ in range(500):
        q = []
        for v in votes:
            like = [math.prod(g if x < 0 else 1 - g if x > 0 else 1 for x, g in zip(v, given[k])) for k in (0, 1)]
            q.append(prior * like[1] / (prior * like[1] + (1 - prior) * like[0]))
        new = [[(sum(p for p, v in zip(ps, votes) if v[r] < 0) + weight * start[k]) / (sum(p for p, v in zip(ps, votes) if v[r]) + weight) for r in range(9)] for k, ps in ((0, [1 - p for p in q]), (1, q))]
        prior = (sum(q) + weight * 0.85) / (len(q) + weight)
        moved = max(abs(a - b) for x, y in zip(new, given) for a, b in zip(x, y))
        given = new
        if moved < 1e-9:
            break
    return [f["words"] >= 10 and 100 * f["repeat"] <= 20 * f["words"] and p >= 0.5 for f, p in zip(fs, q)], fs


def odd_texts(rng):
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in ("an", "el", "or", "um") for c in ("a", "ed", "ing", "s", "é")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    texts = [prose(rng.randint(20, 90)) for _ in range(60)] + [prose(30).upper() for _ in range(4)] + [" ".join(["##", "word", "%%"] * 20) for _ in range(3)]
    texts += [(prose(4) + "\n") * rng.randint(2, 9) for _ in range(6)] + ["\n".join(prose(6)[:-1] for _ in range(8)) for _ in range(5)] + [None, "", " \n ", "a b", "1 2 3 4 5 6 7 8 9 10 11 12"]
    return texts


def test_quality_rules_plain(spark):
    texts = odd_texts(random.Random(21))
    want, fs = plain_verdicts(texts)
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (keep, f) in enumerate(zip(want, fs)):
        r = got[i]
        assert (r["n_words"], r["n_chars_in_words"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (f["words"], f["chars"], f["symbols"], f["dup"], f["repeat"])
        assert r["base_failed"] == (f["words"] < 10 or 100 * f["repeat"] > 20 * f["words"])
        assert r["kept"] == keep, (i, texts[i])
    assert 0 < sum(want) < len(want)


def test_pipeline_odd_rows(spark, tmp_path):
    """Rows without doc_id, with a repeated doc_id, equal rows, extra columns; and an empty table."""
    rng = random.Random(22)
    words = [f"{a}{b}" for a in "bdfgkmn" for b in ("ando", "elia", "orum", "umes")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    good = [prose(60) for _ in range(30)]
    item = prose(30)
    rows = [(i, t) for i, t in enumerate(good)] + [(None, good[3]), (None, good[4] + " more."), (5, good[5]), (5, good[5]), (7, prose(55)), (8, "### $$$ " * 40), (None, "### $$$ " * 40), (None, prose(10) + item), (9, item), (None, prose(70)), (None, prose(70))]
    rows = [(*r, "en", None if i % 5 else "s", 1, i, "x") for i, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, q_slot int, kept string"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted((r["doc_id"] for r in out if r["doc_id"] is not None))
    assert ids == sorted([*range(30), 7]) and sum(r["doc_id"] is None for r in out) == 2
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_columns(spark, tmp_path):
    rows = [(i, f"some words of text number {i} " * 4, "en", "s", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "no such words at all here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_shards_in_order_of_the_mix(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, " ".join("abcdefg"[: rng.randint(1, 7)] * rng.randint(1, 90)), "en", rng.choice(["x", "x", "x", "y", "z", None]), 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    place = {r["doc_id"]: (r["q_slot"], r["q_place"]) for r in mixing.schedule(docs).collect()}
    out = corpus_pipeline.shards(spark, corpus_pipeline.source_mixing(spark, docs, str(tmp_path)), str(tmp_path)).toPandas()
    assert sorted(out["doc_id"]) == list(range(3000)) and set(out["shard"]) == set(range(8))
    for _, g in out.sort_values("slot").groupby("shard"):
        assert list(g["slot"]) == list(range(len(g)))
        assert list(g["doc_id"]) == sorted(g["doc_id"], key=place.get)
