import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from lexloom.llm import decontaminate, html_text, language_id, line_dedup, mixing, paragraph_dedup, quality_classifier, quality_rules, simhash, substring_dedup

LONG = " ".join(f"word{k}" for k in range(60))
ROWS = [
    (1, LONG + "\nshort line\nother line", "en", "a"), (2, LONG + "\nshort line\nother line", "en", "a"), (2, LONG + "\nshort line\nother line", "en", "a"),
    (3, None, None, None), (None, "A lone text!", "de", "b"), (4, "", "en", None), (5, " \n\t", None, "b"), (6, "1234 5678", "fr", "b"), (7, "x" * 3000, "fr", "a"), (8, "one two " + LONG + " end", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, fp string, win string, rank int, keys string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (6, 0, 0), (None, 1, 0), (99, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(LONG.split()[:20])), (2, "Lone Text"), (3, None), (None, "")], "item_id long, text string")


def by(rows, key="doc_id"):
    return {r[key]: r for r in rows}


def test_language(docs, none):
    model = language_id.train(docs)
    rows = language_id.predict(docs, model).collect()
    assert len(rows) == len(ROWS)
    assert all(by(rows)[k].lang_pred == "und" for k in (3, 4, 5, 6)) and by(rows)[1].lang_pred in model["langs"]
    assert language_id.train(none) is None and language_id.predict(none, None).count() == 0
    assert by(language_id.predict(docs, None).collect())[1].lang_pred == "und"


def brute_bytes(rows):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], 1 << 62), 1 << 61 if i is None else i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = set()
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (1 << 61 if i is None else i):
                gone |= set(range(p, p + 50))
        out.append((i, len(b), len(gone), hashlib.sha256(bytes(c for k, c in enumerate(b) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [200, 0])
def test_suffix(docs, none, hot):
    rows = substring_dedup.dedup(docs, hot=hot).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in rows), key=str) == brute_bytes(ROWS)
    assert substring_dedup.dedup(none).count() == 0


def test_lines(spark, docs, none):
    d = line_dedup.dedup(docs)
    assert set(docs.columns) <= set(d.columns)
    rows = by(d.collect())
    assert rows[1].n_removed == 0 and rows[2].n_removed == 3 and rows[2].text == "" and rows[3].text is None
    assert line_dedup.dedup(none).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e\nx", 7, 8, "o", "h", "g")], "doc_id long, text string, n_lines int, n_removed int, o string, h string, gone string")
    r = line_dedup.dedup(odd.unionAll(odd.withColumn("doc_id", odd.doc_id + 1))).orderBy("doc_id").collect()
    assert [(x.n_lines_in, x.n_removed_in, x.o, x.h, x.gone) for x in r] == [(7, 8, "o", "h", "g")] * 2 and [(x.n_lines, x.n_removed, x.text) for x in r] == [(2, 0, "a b c d e\nx"), (2, 2, "")]


def brute_lines(rows, least):
    """Texts without the lines of runs of ``least`` words that stand earlier, by looking at every run of every document."""
    where, docs = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = [(k, x.strip()) for k, x in enumerate((t or "").split("\n")) if x.strip()]
        docs.append((i, t, lines))
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                where.setdefault(tuple(x for _, x in lines[a:b]), (len(docs), a))
    out = []
    for n, (i, t, lines) in enumerate(docs, 1):
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(x for _, x in lines[a:b])
                if sum(len(x.split()) for x in run) >= least and where[run] < (n, a):
                    gone |= {k for k, _ in lines[a:b]}
        out.append((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [1, 5, 9])
def test_lines_against_every_run(spark, least):
    rng = random.Random(least)
    pool = ["a", "b", "c d", "e f", "g h i", "j k l m n", " j k l m n", "", "o p q r s t u v w x"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for k in range(40)] + [(90, None), (91, "")]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), least).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute_lines(rows, least)


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a>m</a></nav><article><h1>H &amp; {0}</h1><p>one  <b>{0}</b><br>x<p>two</p><div class='comments'>c</div></article><footer>f</footer></body></html>"
    rows = [(k, f"http://h.example/{k}", page.format(k)) for k in range(3)] + [(9, None, None), (10, "x", ""), (11, "http://z/", "<p>plain<script>no</script>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (1000, 0):
        got = by(html_text.extract(pages, most).collect(), "page_id")
        assert got[1].text == "H & 1\none 1 x\ntwo" and got[9].text == "" and got[10].text == "" and got[11].text == "plain"
    assert html_text.extract(pages.limit(0)).count() == 0


def test_simhash(docs, none):
    rows = simhash.classes(docs).collect()
    assert len(rows) == len(ROWS)
    c = by(rows)
    assert c[2].component_id == 1 and c[3].fp == c[4].fp == 0 and c[5].component_id == 3
    assert simhash.classes(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.curriculum(docs).collect()
    assert len(rows) == len(ROWS)
    assert sum(r.taken for r in rows) == pytest.approx(sum(r["size"] for r in rows), abs=3) and all(r.taken <= 3 * r["size"] for r in rows)
    assert mixing.curriculum(none).count() == 0


def test_mixing_places_every_pass(spark):
    rows = [(k, "w " * (3 + k % 4), s) for s, n in (("a", 8), ("b", 40), ("c", 40)) for k in range(ord(s) * 100, ord(s) * 100 + n)]
    docs = spark.createDataFrame([*rows, (1, None, "a")], "doc_id long, text string, source string")
    slope, at, want = {"a": -0.5, "b": 0.0, "c": 0.5}, {}, {}
    got = by(mixing.curriculum(docs).collect())
    for k, t, s in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
        n, total, budget, a = len(t.split()), got[k].source_size, math.floor(got[k].target + 0.5), slope[s]
        for x in range(at.get(s, 0), budget, total):
            u = x / budget
            want.setdefault(k, []).append(u if a == 0 else (math.sqrt((1 - a) ** 2 + 4 * a * u) - (1 - a)) / (2 * a))
        at[s] = at.get(s, 0) + n
    assert max(map(len, want.values())) == 3 and got[1].positions is None
    assert all((got[k].positions or []) == pytest.approx(want.get(k, []), abs=1e-6) and got[k].position == (got[k].positions or [None])[0] for k, *_ in rows)
    plan = mixing.plan(docs).collect()
    assert sum(r.words for r in plan) == sum(r.taken for r in got.values()) and sum(r["pass"] is not None for r in plan) == sum(map(len, want.values()))
    assert [r.position for r in plan if r.position is not None] == sorted(x for r in got.values() for x in r.positions or [])


def test_decontaminate(spark, docs, none, bench):
    named = bench.withColumn("item_id", F.concat(F.lit("item-"), F.col("item_id").cast("string")))
    for items, name in ((bench, "1"), (named, "item-1")):
        for most in (1000, 0):
            rows = decontaminate.judge(decontaminate.scan(docs, items, max_set=most)).collect()
            assert len(rows) == len(ROWS)
            c = by(rows)
            assert c[1].n_hit == 20 and c[1]["items"] == [name] and c[None].n_hit == 2 and c[3].n_words == 0 and not c[6].contaminated
    assert decontaminate.scan(none, bench).count() == 0 and decontaminate.scan(docs, bench.limit(0)).count() == len(ROWS)


def test_paragraphs(docs, none):
    rows = by(paragraph_dedup.dedup(docs).collect())
    assert [x.doc_id for x in rows[2].removed] == [1] and rows[1].removed is None and [x.doc_id for x in rows[8].removed] == [1]
    assert paragraph_dedup.dedup(none).count() == 0


def test_quality(docs, none, labels):
    rows = quality_classifier.resample(docs, labels).collect()
    assert len(rows) == len(ROWS) and by(rows)[1].kept
    assert quality_classifier.resample(none, labels).count() == 0
    assert all(r.kept for r in quality_classifier.resample(docs, labels.limit(0)).collect())


def test_rules(docs, none):
    ledger = quality_rules.ledger(docs)
    rows = by(quality_rules.apply_policy(ledger).collect())
    assert rows[3].base_failed and rows[1].kept and rows[1].n_words == 64
    assert {r["rule"] for r in quality_rules.ablation(ledger).collect()} == set(quality_rules.POLICIES["v2"])
    assert quality_rules.ledger(none).count() == 0


def test_paragraphs_in_large_bands(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(150):  # near copies of near copies: many links are between texts far from the most frequent one
        w = list(texts[rng.randrange(len(texts))] if texts and k % 3 else base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = f"x{rng.randrange(50)}"
        texts.append(w)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(56)} for w in texts]
    root = list(range(150))
    for a in range(150):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    rows = by(paragraph_dedup.dedup(docs).collect())
    assert {k: rows[k].removed[0].doc_id if rows[k].removed else k for k in rows} == dict(enumerate(root))


def test_suffix_hot_keys_of_batches(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = [word(90), word(70)]
    rows = [(k, word(30) + passage[k % 3 % 2] + word(20)) for k in range(60)]
    rng.shuffle(rows)  # each of several batches holds several documents of a passage, the first one anywhere
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = substring_dedup.dedup(docs, hot=2).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_bytes(rows)


def test_suffix_memory_bounds(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = [word(90), word(70), word(130)]
    rows = [(k % 55, word(rng.randrange(40)) + passage[k % 3][rng.randrange(20) :] + word(rng.randrange(60))) for k in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (0, substring_dedup.HOT):  # contexts are handed on many times a batch
        got = substring_dedup.dedup(docs, hot=hot, most=20).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_bytes(rows)
    contexts = [t.encode() for _, t in rows if len(t) >= substring_dedup.MIN_LEN]
    found = lambda most: {(n, c, p) for n, cs, ps in substring_dedup.maximal_repeats(contexts, np.arange(len(contexts)) // 40, most) for c, p in zip(cs.tolist(), ps.tolist(), strict=True)}
    assert found(1) == found(1 << 16) and len(found(1)) > 100
    # a key of one document in each of many batches is not hot; one of many documents is, whatever the batches
    keys = np.array([7, 9], np.uint32).tobytes()
    offered = lambda n, more: pa.table({"b": [0] * n, "keys": [keys] * n, "many": [np.array([1, more] if more else [], np.uint32).tobytes()] * n})
    assert substring_dedup._hot_cells(substring_dedup.HOT)(offered(300, 0)).num_rows == 0
    assert substring_dedup._hot_cells(substring_dedup.HOT)(offered(3, 4000)).column("cell").to_pylist() == [9]


def test_lines_of_one_line_runs(spark):
    rng = random.Random(9)
    rows = [(k % 25 if k % 9 else None, "\n".join(rng.choice(["one", "a b c", " a b c", "", f"x{rng.random()}", "same words here"]) for _ in range(6))) for k in range(40)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    per_line = {}
    for r in got:
        for x in r.text.split("\n"):
            per_line[x.strip()] = per_line.get(x.strip(), 0) + bool(x.strip())
    assert {x for x in per_line if x} == {x.strip() for _, t in order for x in t.split("\n")} - {""} and max(per_line.values()) == 1
    lines = [len([x for x in t.split("\n") if x.strip()]) for _, t in rows]
    assert sum(r.n_removed for r in got) == sum(lines) - len([x for x in per_line if x])


def staged(spark, rows):
    return spark.createDataFrame([(*r, "en", "a", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_stages_judge_rows(spark, tmp_path):
    hit, fine = " ".join(LONG.split()[:20]), [" ".join(f"{c}{k}" for k in range(40)) for c in "abcdef"]
    spark.createDataFrame([(1, hit)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(None, hit), (None, fine[0]), (1, hit), (1, fine[1]), (2, fine[2]), (2, fine[2]), (3, None), (None, None)]
    texts = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=str)
    assert texts(corpus_pipeline.clean(spark, staged(spark, rows), str(tmp_path))) == sorted((r for r in rows if r[1] != hit), key=str)
    rows = [(5, fine[0]), (5, fine[0]), (5, fine[1]), (None, fine[0]), (None, fine[2]), (None, fine[2]), (None, fine[3]), (None, fine[1]), (4, fine[4]), (4, fine[5])]
    assert texts(corpus_pipeline.near(spark, staged(spark, rows), str(tmp_path))) == sorted({(5, fine[0]), (5, fine[1]), (None, fine[2]), (None, fine[3]), (4, fine[4]), (4, fine[5])}, key=str)
    rng = random.Random(2)
    rows = [(k % 12 if k % 5 else None, " ".join(rng.choice(fine[k % 2 * 3 : k % 2 * 3 + 3]).split()[:30] + [f"y{k}"])) for k in range(80)]
    docs = corpus_pipeline.keyed(staged(spark, rows))
    drawn = quality_classifier.resample(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()
    assert 0 < sum(r.kept for r in drawn) < 80
    got = corpus_pipeline.keyed(corpus_pipeline.quality(spark, docs, str(tmp_path))).collect()
    assert sorted(r.row for r in got) == sorted(r.row for r in drawn if r.kept)


def brute_components(pairs, n):
    root = list(range(n))
    for a, b in pairs:
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    return root


@pytest.mark.parametrize("bucket", [2048, 4])
def test_simhash_against_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)  # at 4 the buckets are dealt again on finer blocks
    rng = random.Random(bucket)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({x ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for x in base for _ in range(6)} | {base[0] & ~255 | k for k in range(40)})
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {frozenset((fps.index(r.a % (1 << 64)), fps.index(r.b % (1 << 64)))) for r in simhash.links(frame).collect()}
    near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert brute_components([tuple(p) for p in got if len(p) == 2], len(fps)) == brute_components(near, len(fps))


def test_simhash_of_texts(spark):
    import xxhash

    rng = random.Random(1)
    words = [f"w{k}" for k in range(30)]
    texts = [None, "", " \t\n", "One", "one TWO", "ONE two three"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 40))) for _ in range(40)]
    texts += [t.upper() for t in texts[6:16]]

    def mark(t):
        w = (t or "").lower().split()
        if not w:
            return 0
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    marks = [mark(t) for t in texts]
    rows = by(simhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [rows[k].fp % (1 << 64) for k in range(len(texts))] == marks
    near = [(a, b) for a in range(len(marks)) for b in range(a) if (marks[a] ^ marks[b]).bit_count() <= 2]
    assert [rows[k].component_id for k in range(len(texts))] == brute_components(near, len(marks))


def test_kth_against_a_sort(spark):
    rng = random.Random(4)
    values = [rng.choice([-1.5, 0.0, 2.25]) for _ in range(30)] + [rng.uniform(-1e6, 1e6) for _ in range(200)] + [1e-300, 1e300]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    order = sorted(values, reverse=True)
    assert [quality_classifier.kth(keys, "key", k) for k in (1, 2, 40, 115, 232)] == [order[k - 1] for k in (1, 2, 40, 115, 232)]


def test_quality_weights_against_counts(spark):
    import numpy as np

    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(50)]
    rows = [(k, " ".join(rng.choice(vocabulary[: 25 if k % 2 else 50]) for _ in range(30))) for k in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    ratio, apart = quality_classifier.fit(docs, labels)
    good = sorted(k for k in range(60) if k % 2)
    assert apart == good[::2]
    n = np.zeros((2, quality_classifier.BUCKETS))
    for k, t in rows:
        f = np.bincount(quality_classifier.features((t or "").encode()), minlength=quality_classifier.BUCKETS)
        n[0] += f
        n[1] += f * (k in good[1::2])
    want = np.log((n[1] + quality_classifier.SMOOTH) / (n[0] * (n[1].sum() / n[0].sum()) + quality_classifier.SMOOTH))
    assert np.allclose(ratio, want)
    drawn = by(quality_classifier.resample(docs, labels).collect())
    for k, t in rows:
        assert drawn[k].log_weight == pytest.approx(sum(want[x] for x in quality_classifier.features((t or "").encode())))
    kept = sorted((r.key for r in drawn.values() if r.kept), reverse=True)
    assert kept == sorted((r.key for r in drawn.values()), reverse=True)[: len(kept)] and len(kept) < len(rows)


def test_language_accuracy(spark):
    rng = random.Random(6)
    syllables = {"en": ["the", "ing", "er", "on", "st"], "de": ["sch", "ung", "ein", "ich", "tz"], "fr": ["eau", "oi", "que", "eux", "re"]}
    rows = [(k, " ".join("".join(rng.choice(syllables[x]) for _ in range(rng.randrange(1, 4))) for _ in range(25)), x) for k in range(240) for x in [list(syllables)[k % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r for r in language_id.predict(docs, language_id.train(docs)).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(got) > 30 and sum(r.lang_pred == rows[r.doc_id][2] for r in got) >= 0.97 * len(got)


def wrapped(k, notice, menu, extra=""):
    body = "".join(f"<p>text {k} {j} words</p>" for j in range(3))
    return f"<html><body><div><div>{menu}</div></div><div class='x1'><div><h2>Title {k}</h2><div>{notice}</div>{extra}{body}<ul><li>item {k}</li></ul></div></div><div>All rights kept</div></body></html>"


def test_html_induction_decides(spark):
    """Hosts without article elements or telling classes: what is alike on all pages goes, headings and lists of the content stay."""
    rows = [(k, f"http://a.example/{k}", wrapped(k, "Read more of this", "Home and news", "<h3>sub</h3>" * (k % 3 == 0) + f"<table><tr><td>cell {k}</td></tr></table>" * (k % 4 == 1))) for k in range(24)]
    rows += [(100 + k, f"http://b.example/{k}", wrapped(7, "Read more of this", "Home and news")) for k in range(12)]  # copies of one page
    rows += [(200, "http://c.example/", wrapped(9, "note", "menu"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got, plain = (by(html_text.extract(pages, induced=x).collect(), "page_id") for x in (True, False))
    for k in range(24):
        want = [f"Title {k}", *["sub"] * (k % 3 == 0), *[f"cell {k}"] * (k % 4 == 1), *[f"text {k} {j} words" for j in range(3)], f"item {k}"]
        told = got[k].text.split("\n")
        assert [x for x in told if x != "sub"] == [x for x in want if x != "sub"], (k, told)
        assert "Read more of this" in plain[k].text and "All rights kept" in plain[k].text
    assert {got[100 + k].text for k in range(12)} == {plain[107].text} and got[200].text == plain[200].text


def test_html_hidden_and_hostile(spark):
    deep = "<div>" * 400 + "<p>deep</p>"
    rows = [(1, "http://h/", "<body><div hidden>no</div><p>yes</p></body>"), (2, "http://h/", deep), (3, "http://h/", "<p>" + "word " * 50_000), (4, None, "<p>a&amp;b")]
    got = by(html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), "page_id")
    assert got[1].text == "yes" and got[2].text == "deep" and len(got[3].text) == 249_999 and got[4].text == "a&b"


def test_passages_inside_long_lines(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [[word() for _ in range(n)] for n in (55, 70, 120)]
    rows, held = [], []
    for k in range(120):
        own = [[word() for _ in range(rng.randrange(30, 80))] for _ in range(2)]
        inside = passage[k % 3] if k % 2 else []
        held.append(k % 3 if k % 2 else None)
        rows.append((k, " ".join(own[0] + inside + own[1]) + "\n" + " ".join(word() for _ in range(12))))
    got = by(paragraph_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    seen, caught, due = set(), 0, 0
    for k, p in enumerate(held):
        if p is None or p not in seen:
            assert not got[k].passages and got[k].text == rows[k][1]
            seen.add(p)
            continue
        due += 1
        caught += bool(got[k].passages)
        for x in got[k].passages:
            assert set(rows[k][1].split()[x.start : x.end]) <= set(passage[p])
    assert due > 50 and caught >= 0.9 * due


def test_pieces_of_odd_texts():
    for t in (b"", b" ", b"one", b"a a", b"a " * 40, b"x " * 30 + b"y z " * 20 + b"q", " ".join(map(str, range(200))).encode()):
        w = paragraph_dedup.Words(t)
        cut = w.pieces().tolist()
        assert cut == sorted(set(cut)) and cut[0] == 0 and cut[-1] == len(w.hash)
        assert paragraph_dedup.cut(t, set(), {})[0] == t


def test_stages_against_plain_python(spark, tmp_path):
    """Line and near-duplicate stages of the pipeline on rows with null and repeated ids; mixing takes what its targets say."""
    rng = random.Random(13)
    lines = [" ".join(f"{a}{k}" for k in range(9)) for a in "pqrstu"] + ["one", "two three"]
    rows = [(k % 30 if k % 7 else None, "\n".join(rng.choice(lines) if rng.random() < 0.7 else f"own {k} {j}" for j in range(4))) for k in range(60)]
    keep = sorted(set(rows), key=str)
    one = {}
    for i, t in keep:
        one.setdefault(i, t)
    rows = sorted(one.items(), key=str)
    got = corpus_pipeline.lines(spark, staged(spark, rows), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute_lines(rows, 1) and all(r.n_chars == len(r.text) for r in got)
    plan = corpus_pipeline.mix(spark, staged(spark, rows), str(tmp_path)).collect()
    words = {i: len(t.split()) for i, t in rows}
    assert sum(r.words for r in plan) == sum(words.values()) and {r.doc_id for r in plan} == set(words)


def test_mixing_follows_the_schedules(spark):
    rows = [(k, "w " * (1 + k % 3), "abc"[k % 5 % 3]) for k in range(4000)]
    plan = [r for r in mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r["pass"] is not None]
    target = {r.source: r.target for r in plan}
    total = sum(target.values())
    for s, a in zip("abc", mixing.SLOPES, strict=True):
        for tenth in range(10):  # words of a source by tenths of time, and of all sources by tenths of progress
            due = target[s] * (0.1 + a * ((tenth + 1) ** 2 / 100 - (tenth + 1) / 10 - tenth**2 / 100 + tenth / 10))
            assert sum(r.words for r in plan if r.source == s and tenth / 10 <= r.position < (tenth + 1) / 10) == pytest.approx(due, abs=10)
    for tenth in range(10):
        assert sum(r.words for r in plan if tenth / 10 <= r.progress < (tenth + 1) / 10) == pytest.approx(total / 10, abs=30)
