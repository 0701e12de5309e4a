"""Periodic runs, spelling variants and exact top-k against brute force; article text of generated pages; ties and copies in shards; decontamination without broadcasts."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import brown, common, decontamination, html_blocks, language, mixing, periodic_runs, queries, sharding, spelling, topk

# 5 language


def test_language_equals_the_network_over_whole_texts(spark):
    """lang_pred and score by one forward pass over every window of every word of a text, position by position, without the labeller's sums."""
    rng = random.Random(9)
    stems = {"en": ["the", "thing", "with", "hand"], "fr": ["où", "été", "eux", "ça"], "de": ["über", "straße", "nicht"]}
    rows = [(i, " ".join(rng.choice(stems[lang]) + rng.choice(["", "s", "en"]) for _ in range(rng.randint(1, 30))), lang) for i in range(90) for lang in [rng.choice(list(stems))]]
    rows += [(200, "w" * 200_000, "en"), (201, None, "en"), (202, "12 !", "fr"), (203, "", None), (204, "Où THE " * 500, None), (205, "x" * 23 + " " + "y" * 24 + " " + "é" * 25, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.fit(d, sample_docs=20, sample_words=10)
    assert max(len(w) for r in rows for w in (r[1] or "").split()) > language.LEARNT_CHARS
    for r in language.label(d.select("doc_id", "text"), model).collect():
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total, n = np.zeros(len(model.labels)), 0
        for w, times in Counter(r.text.lower().encode().split()).items():
            for piece, a, b in language.pieces_of(w):
                total += times * model.net.forward(np.frombuffer(piece, np.uint8)[None])[0][0][a:b].sum(0)
                n += times * (b - a)
            assert sum(b - a for _, a, b in language.pieces_of(w)) == len(w) + 2
        y = total / n
        assert abs(r.score - y.max()) < 1e-4 and y[model.labels.index(r.lang_pred)] > y.max() - 1e-4


# 8 HTML


def test_html_keeps_the_article_whatever_surrounds_it():
    """200 articles of every kind of block, each with and without menu, header, footer and the rest: the same text each time."""
    rng, trees = random.Random(3), html_blocks.trained()
    w = lambda a, b: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(a, b)))
    for _ in range(200):
        inner, want = "", []
        for _ in range(rng.randint(1, 9)):
            t = w(1, rng.choice([3, 12, 80]))
            kind = rng.randrange(6)
            if kind == 5:
                items = [w(1, 4) for _ in range(rng.randint(1, 5))]
                inner += "<ul>" + "".join(f"<li><a href=#x>{i}</a></li>" for i in items) + "</ul>"
                want += items
            else:
                inner += (f"<p>{t}</p>", f"<h2>{t}</h2>", f"<h2><a href=#s>{t}</a></h2>", f"<p><a href=x>{t}</a></p>", f"<blockquote>{t}</blockquote>")[kind]
                want.append(t)
        tag = rng.choice(["article", "main", "div class='entry-content'", "div role=main", "div class=post"])
        article = f"<{tag}>{inner}</{tag.split()[0]}>"
        nav, ad = f"<nav><ul>{''.join(f'<li><a href=/>{w(1, 3)}</a></li>' for _ in range(5))}</ul></nav>", f"<div class=ad>{w(3, 20)}</div>"
        header, side, footer = f"<header><h1>{w(1, 4)}</h1></header>", f"<aside><p>{w(5, 60)}</p></aside>", f"<footer><p>{w(2, 20)}</p></footer>"
        for page in (article, nav + article, article + footer, header + nav + ad + article + side + footer, f"<html><body>{nav}<p>{w(4, 30)}</p>{article}<p>{w(1, 40)}</p></body></html>", article.replace("</p>", "")):
            assert html_blocks.main_text(page, trees) == "\n".join(want), page


def test_html_short_pages_and_names():
    trees = html_blocks.trained()
    for page, want in {
        "<p>Only eleven words stand here and nothing else on the page.</p>": "Only eleven words stand here and nothing else on the page.",
        "<article><p>First words here.</p><svg/><p>Second paragraph.</p></article>": "First words here.\nSecond paragraph.",
        '<article><div class="ad-hoc-query"><p>About queries.</p></div><div class="tags-and-comments">More.</div><div class="ad-slot">Buy.</div><div class="comments-area-2">No.</div></article>': "About queries.\nMore.",
        "<nav><a href=/>Home</a></nav><h1>A title of some words</h1><p>" + "Word after word. " * 12 + "</p><footer>Imprint</footer>": "A title of some words\n" + ("Word after word. " * 12).strip(),
    }.items():
        assert html_blocks.main_text(page, trees) == want


# 9 sharding


def placed(df, **more):
    return sorted((str(r.doc_id), str(r.text), r.extra, r.shard, r.slot) for r in sharding.shuffle_into_shards(df, 4, bucket_bytes=20_000, **more).collect())


def test_shards_of_tied_rows_and_copies(spark, monkeypatch):
    """Rows that differ in another column only, and many copies of one row: the input's partitions decide nothing, and a hot row fills no bucket."""
    monkeypatch.setattr(sharding, "COPIES", 50)
    ties = [(7, "same text", str(i)) for i in range(2000)]
    copies = [(8, "copy", "x")] * 1500 + [(None, None, None)] * 300
    d = spark.createDataFrame(ties + copies, "doc_id long, text string, extra string")
    one = placed(d.repartition(3))
    assert one == placed(d.orderBy(F.desc("extra")).repartition(11)) and len(one) == 3800
    assert Counter((a, b, c) for a, b, c, *_ in one) == Counter((str(a), str(b), c) for a, b, c in ties + copies)
    assert sorted((s, n) for *_, s, n in one) == sorted((s, n) for s in range(4) for n in range(950))
    at = [n * 4 + s for a, *_, s, n in one if a == "8"]
    assert max(at) - min(at) > 3000  # all over the order, not in one bucket


def test_shards_of_rows_with_maps(spark):
    d = spark.createDataFrame([(i % 3, "t", {"k": i % 2}) for i in range(20)], "doc_id long, text string, extra map<string,int>")
    got = sharding.shuffle_into_shards(d, 2).collect()
    assert Counter((r.doc_id, r.extra["k"]) for r in got) == Counter((i % 3, i % 2) for i in range(20))


# 4 decontamination


def test_decontamination_by_shuffles(spark, monkeypatch):
    """With no room for a broadcast, and with room for a few hashes at a time, the results are the same, and rows without hits are in no shuffle."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    bench = [(f"b{k}", " ".join(rng.choice(words) for _ in range(rng.choice([5, 13, 40])))) for k in range(30)]
    docs = []
    for i in range(200):
        t = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if i % 4 == 0:
            t[5:5] = bench[i % 30][1].split()
        docs.append((i, " ".join(t) if i % 50 else None, str(i)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string, extra string"), spark.createDataFrame(bench, "item_id string, text string")
    rows = lambda: sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated, r.extra) for r in decontamination.contamination(d, b).collect())
    want = rows()
    assert sum(r[4] for r in want) >= 20
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert rows() == want
    monkeypatch.setattr(decontamination, "BROADCAST_HASHES", 2000)
    assert rows() == want
    monkeypatch.setattr(decontamination, "BROADCAST_HASHES", 0)
    assert rows() == want
    monkeypatch.setattr(decontamination, "BROADCAST_HASHES", 64 << 20)
    plan = decontamination.contamination(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "LeftAnti" in plan and "BroadcastHashJoin" in plan


# 11 periodic runs


def brute_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(i, j) + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def run_texts():
    rng = random.Random(11)
    out = [None, "", " \n\t", "one", "a " * 11, "a " * 12, "A a " * 9, "x " * 4000, "é è " * 40, "　w " * 30, "word" * 3000]
    for _ in range(120):
        n, k = rng.choice([13, 40, 90]), rng.choice([1, 2, 3, 6, 40])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randrange(n), rng.randint(1, 9)
            for i in range(a, min(n, a + rng.randint(8, 60))):
                w[i] = w[a + (i - a) % p]
        out.append("\n".join(f"w{x}" for x in w))
    return out


def test_periodic_runs(spark, monkeypatch):
    texts = run_texts()
    d = spark.createDataFrame([(i, t, "mine", "x") for i, t in enumerate(texts)] + [(5, texts[5], "mine", "x"), (None, texts[7], None, "x")], "doc_id long, text string, Runs string, row string").repartition(3)
    for group in (2 << 20, 300):
        monkeypatch.setattr(periodic_runs, "GROUP_BYTES", group)
        got = periodic_runs.find_runs(d)
        assert got.columns == ["doc_id", "text", "row", "runs", "collapsed"]
        rows = got.collect()
        assert len(rows) == len(texts) + 2
        for r in rows:
            w = (r.text or "").encode().split()
            want = brute_runs(w) if len(w) < 500 else [(0, len(w), 1)]
            assert [tuple(x) for x in r.runs] == want
            gone = {i for s, n, q in want for i in range(s + q, s + n)}
            assert r.collapsed.encode() == b" ".join(x for i, x in enumerate(w) if i not in gone)
    assert periodic_runs.find_runs(d.limit(0)).count() == 0


@pytest.mark.parametrize("least", [2, 5, 20])
def test_runs_of_other_lengths(least):
    rng = np.random.default_rng(least)
    texts = [rng.integers(0, k, n) for k in (1, 2, 3, 20) for n in (0, 1, 5, 30, 100) for _ in range(3)]
    assert periodic_runs.runs_of(texts, least) == [brute_runs(list(t), least) for t in texts]


def test_runs_in_linear_time():
    """One word over and over, and one phrase between ever new words: neither takes a look at all pairs of places."""
    one = np.zeros(60_000, np.int64)
    phrase = np.concatenate([np.r_[np.arange(7), 1000 + np.arange(8) + 8 * i] for i in range(6000)])
    assert periodic_runs.runs_of([one, phrase]) == [[(0, 60_000, 1)], []]


# 12 spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_near_pairs_of_sorted_lists():
    rng = random.Random(1)
    for k in range(300):
        alphabet = "ab" if k % 2 else "abcé"
        w = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(0 if k % 3 else 3, 6))) for _ in range(rng.randint(1, 60))})
        assert sorted(spelling.near_pairs(w)) == [(i, j) for i in range(len(w)) for j in range(i + 1, len(w)) if one_edit(w[i], w[j])]


def test_spelling_variants(spark):
    """Lists of at most three words are cut as far as they go; the results are those of whole lists and of all pairs."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abcé") for _ in range(rng.choice([5, 6, 7, 12, 40]))) for _ in range(40)]
    counts = Counter()
    for b in base:
        counts[b] += rng.choice([3, 20, 300])
        for _ in range(6):
            i = rng.randrange(len(b))
            counts[rng.choice([b[:i] + b[i + 1 :], b[:i] + "d" + b[i + 1 :], b[:i] + "a" + b[i:]])] += rng.choice([1, 2, 3, 4, 9])
    counts |= Counter({"hot": 50, "hotel": 2, "aaaaa": 3, "aaaab": 6, "aaaac": 6, "aaaad": 12, "aaaadd": 24})
    occurrences = [(w, "x") for w, n in counts.items() for _ in range(n)] + [(None, "x")] * 9
    rng.shuffle(occurrences)
    d = spark.createDataFrame(occurrences, "word string, n string").repartition(3)
    vocabulary = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in vocabulary if one_edit(w, v)] for w in vocabulary}
    form = {}
    for w, n in vocabulary.items():
        top = min(near[w], key=lambda v: (-vocabulary[v], v), default=None)
        form[w] = top if top is not None and vocabulary[top] >= 2 * n else None
    want = set()
    for w, n in vocabulary.items():
        root = w
        while form[root] is not None:
            root = form[root]
        want.add((w, form[w], root, n, len(near[w]), vocabulary.get(form[w])))
    for most in (3, 2000):
        got = spelling.variants(d, most=most)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        rows = [tuple(r) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want)
    assert spelling.variants(d.limit(0)).count() == 0
    lists = spelling.lists_of(spark.createDataFrame(list(vocabulary.items()), "word string, n long"), 3)
    window = F.col("L") - F.length("head") - F.length("tail")
    assert lists.groupBy(spelling.KEY).count().where((F.col("count") > 3) & (window >= 2)).count() == 0


def test_runs_of_letters(spark):
    d = spark.createDataFrame([(1, "Ünï-Straße x9y ÀB×cĀd"), (None, None), (2, "")], "doc_id long, text string")
    assert sorted(r.run for r in spelling.runs_of_letters(d).collect()) == sorted(["Ünï", "straße", "x", "y", "Àb×c", "d"])


# 13 top-k


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, rank string, Score string").repartition(4)


def brute_top(rows, k=10):
    whole = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(whole):
        if i % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(q, c, strict=False)), j) for b, (j, c) in enumerate(whole) if b != a)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def test_top_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)]) for i in range(700)]
    rows += [(i, [0.5] * 8) for i in range(1000, 1250)]  # many equal vectors: ties go by vec_id
    rows += [(300, rows[5][1]), (301, rows[300][1]), (2000, None), (2100, [1.0, None] * 4), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8), (None, [1.0] * 8), (2400, []), (2500, [1.0, 2.0]), (-100, [-1.0] * 8)]
    d = vectors(spark, rows)
    for tile, qtile, shard, fan in ((4096, 1024, 4, 16), (37, 5, 2, 2), (1, 3, 1, 3)):
        if tile == 1:
            d = vectors(spark, rows[:40] + rows[-10:])
        for name, value in (("TILE", tile), ("QUERY_TILE", qtile), ("SHARD_TILES", shard), ("FAN", fan)):
            monkeypatch.setattr(topk, name, value)
        got = topk.top_k(d, F.col("vec_id") % 100 == 0)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(tuple(r) for r in got.collect()) == brute_top(rows if tile > 1 else rows[:40] + rows[-10:])
    assert topk.top_k(d.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_k(d, F.lit(None).cast("boolean")).count() == 0
    few = vectors(spark, [(0, [1.0]), (1, [2.0])])
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 2048)]


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for size in (10, 5000, 2**25, 2**30, 2**40):
        q, c = rng.integers(-size, size, (5, 16)), rng.integers(-size, size, (7, 16))
        reach = float(np.sqrt((q.astype(float) ** 2).sum(1).max() * (c.astype(float) ** 2).sum(1).max()))
        want = np.clip(q.astype(object) @ c.astype(object).T, -topk.LONG, topk.LONG)
        assert (topk.products(q, c, reach).astype(object) == want).all()


def test_queries_are_registered():
    for n in (11, 12, 13):
        assert any(q.startswith(f"op{n}_") for q in queries.QUERIES)


# 3 mixing


def test_mix_of_many_copies(spark):
    """Every copy of a row has a draw of its own, the input's partitions decide nothing, and no window ranks the copies."""
    rows = [(1, "a b c", "hot", "x")] * 3000 + [(1, "a b c", "hot", str(i)) for i in range(50)] + [(i, "w " * 20, "cold", "y") for i in range(2, 40)] + [(None, None, None, None)] * 7
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string")
    count = lambda df: Counter((r.doc_id, r.text, r.source, r.extra) for r in mixing.emit(df).collect())
    one = count(d.repartition(3))
    assert one == count(d.orderBy("extra").repartition(7))
    mixed = mixing.mix(d, by_row=True)
    assert mixed.count() == len(rows)
    copies = Counter(r.copies for r in mixed.where("doc_id = 1").collect())
    assert len(copies) > 1 and one[(1, "a b c", "hot", "x")] == sum(r.copies for r in mixed.where("extra = 'x'").collect())
    per = mixed.where("source = 'hot'").agg(F.sum(F.col("size") * F.col("copies")), F.first("target")).first()
    assert abs(per[0] - per[1]) < 0.1 * per[1]
    assert "row_number" not in mixed._jdf.queryExecution().optimizedPlan().toString()


def test_brown_chunk_of_short_words_in_bounded_memory():
    """op1: a chunk of three million words, a step of which took up to 40 bytes for each."""
    import tracemalloc

    n, kinds = 3_000_000, 150_000
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.3, n) % kinds).astype(np.uint32)
    ids[-1] = 0
    words = [b"w%x" % i for i in range(1, kinds)]
    planes, held = ids.view(np.uint8).reshape(-1, 4).T.tobytes(), bytes((rng.random((ids == 0).sum()) < 0.15).astype(np.uint8))
    chunk = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([b" ".join(words)], pa.binary()), pa.array([planes], pa.binary()), pa.array([held], pa.binary())], ["chunk", "words", "ids", "held_out"])
    head, cls = {w: i for i, w in enumerate(words[: brown.HEAD])}, np.append(np.arange(brown.HEAD + brown.GROUPS) % (brown.CLASSES - 1), brown.CLASSES - 1)
    for step, most in ((brown._vocabulary, 18), (brown._pairs(head), 28), (brown._neighbours(head, cls), 18)):
        tracemalloc.start()
        rows = sum(b.num_rows for b in step(iter([chunk])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows and peak < most * n
