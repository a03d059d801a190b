"""Small tables against brute force, with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.llm import ann, decontamination, html_extract, language, mixing, ngram_join, quality, queries, sharding, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = words(rng, 120)
    parts = base.split()
    near = [" ".join(parts[:k] + ["changed"] + parts[k + 1 :]) for k in (10, 60, 100)]
    texts = [base, base, *near, base.upper(), words(rng, 90), "", None, "one two", "one two", "a b c d e", "é " * 150, words(rng, 60) + " " + base[:300], base[100:400] * 2, "x" * 700, words(rng, 3000)]
    out = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, 0) for i, t in enumerate(texts)]
    return [*out, out[0], (None, base, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "score")  # an extra column whose name clashes


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_near_duplicates(docs, rows, none):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        want.append((r[0], len(sets[i]), (min(ids) if ids else None) if sets[i] else r[0]))
    got = [tuple(r) for r in ngram_join.near_duplicates(docs).collect()]
    assert Counter(got) == Counter(want)
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, r in enumerate(rows[:17]) if not sets[i] or want[i][2] == i) + Counter([None])
    assert ngram_join.near_duplicates(none).count() == 0


def test_repeated_strings(docs, rows, none):
    raws = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[s : s + 200] for b in raws for s in range(len(b) - 199))
    want = []
    for r, b in zip(rows, raws):
        cut = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                cut[s : s + 200] = True
        runs = int((cut & ~np.concatenate([[False], cut[:-1]])).sum()) if len(b) else 0
        want.append((r[0], len(b), int(cut.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~cut].tobytes()).hexdigest()))
    assert Counter(tuple(r) for r in suffix_dedup.digest(docs, batches=3).collect()) == Counter(want)
    assert suffix_dedup.digest(none).count() == 0
    kept = {(r["doc_id"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert kept == {(w[0], w[4]) for w in want}


def test_decontamination(spark, docs, rows, none):
    items = spark.createDataFrame([(1, rows[6][1][:200]), (2, "one TWO"), (3, None), (4, ""), (5, "not there at all")], "item_id long, text string")
    token = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    want = []
    for r in rows:
        w, hit, ids = token(r[1]), set(), set()
        for item in items.collect():
            x = token(item["text"])
            n = min(13, len(x))
            for k in range(len(x) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == x[k : k + n]:
                        hit |= set(range(at, at + n))
                        ids.add(str(item["item_id"]))
        want.append((r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    got = Counter(tuple(r) for r in decontamination.digest(docs, items).collect())
    assert got == Counter(want)
    blocks = decontamination.scan(docs, items, ["doc_id"], block_bytes=100)  # several passes
    assert Counter((r["doc_id"], r["n_hit"]) for r in blocks.collect()) == Counter((w[0], w[2]) for w in want)
    assert decontamination.decontaminate(docs, items).count() == sum(not w[5] for w in want)
    cut = {r["text"] for r in decontamination.decontaminate(docs, items, "spans").where("doc_id = 9").collect()}
    assert cut == {""}
    assert decontamination.digest(none, items).count() == 0 and decontamination.digest(docs, items.where("false")).where("n_hit > 0").count() == 0


def test_sharding(docs, rows, none):
    out = sharding.shard_documents(docs, 4).toPandas()
    assert len(out) == len(rows) and out.groupby("shard").size().max() - out.groupby("shard").size().min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    assert sharding.shard_documents(none, 4).count() == 0


def test_hypergeometric_draws():
    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 12, 20, 9) for _ in range(20_000)]
    assert np.mean(draws) == pytest.approx(9 * 12 / 32, abs=0.05) and np.var(draws) == pytest.approx(9 * 12 / 32 * 20 / 32 * 23 / 31, abs=0.06)
    matrix = np.array(sharding.communication_matrix([5, 0, 9], [4, 4, 6], 3))
    assert matrix.sum(axis=1).tolist() == [5, 0, 9] and matrix.sum(axis=0).tolist() == [4, 4, 6]


def test_mixing(docs, rows, none):
    out = mixing.mix(docs, {"s0": 5, "s1": 3, "s2": 1, None: 2}, block_rows=1).toPandas()
    assert len(out) == len(rows) and sorted(out["slot"]) == list(range(len(rows)))
    assert (out["release"] <= out["slot"]).all() and (out["slot"] < out["deadline"]).all()
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": 1})
    assert mixing.mix(none).count() == 0 and mixing.mixed_order(docs).columns == docs.columns
    shares, order = {"a": 7, "b": 2, "c": 1}, mixing.period({"a": 7, "b": 2, "c": 1})
    for s, w in shares.items():
        assert all(abs(order[:t].count(s) - w * t / 10) < 1 for t in range(11))


def test_mixing_keeps_to_the_given_weights():
    """Less than one block off at every slot of the first phase, however long; each block once."""
    even = {f"s{k:02}": 500_000 * 2 // 57 for k in range(19)}
    for rows, weights in (({"hot": 166_666} | even, None), ({"big": 400_000} | {f"t{k}": 16_000 for k in range(400)}, {"big": 400.0} | {f"t{k}": 1.0 for k in range(400)})):
        blocks, weights = {s: -(-n // 16) for s, n in rows.items()}, weights or mixing.tempered(rows)
        share = {s: w / sum(weights.values()) for s, w in weights.items()}
        placed, done, worst = list(mixing.schedule(blocks, weights)), dict.fromkeys(rows, 0), 0.0
        assert [p[3] for p in placed] == list(range(sum(blocks.values())))
        assert all(release <= slot < deadline for _, _, _, slot, release, deadline in placed)
        for s, phase, block, slot, _, _ in placed:
            assert block == done[s]
            if phase == 0:  # a source is furthest off just before and just after its own blocks
                worst = max(worst, abs(done[s] - share[s] * slot), abs(done[s] + 1 - share[s] * (slot + 1)))
            done[s] += 1
        assert done == blocks and worst < 1 + 1e-6


def test_mixing_in_pieces(docs, monkeypatch):
    weights = {"s0": 5, "s1": 3, "s2": 1, None: 2}
    names = ["doc_id", "source", "block", "phase", "slot", "in_block", "release", "deadline"]
    want = Counter(map(tuple, mixing.mix(docs, weights, block_rows=1).select(names).collect()))
    for name, value in (("PIECE_SLOTS", 7), ("CHUNK", 3), ("BROADCAST_SLOTS", 0)):
        monkeypatch.setattr(mixing, name, value)
    assert Counter(map(tuple, mixing.mix(docs, weights, block_rows=1).select(names).collect())) == want


def test_learned_operators_on_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(17)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    for out in (toxicity.digest(docs, labels), toxicity.digest(docs, labels.where("false")), language.digest(docs), quality.digest(docs)):
        scores = [r["score"] for r in out.collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert {r["lang_pred"] for r in language.digest(docs).where("doc_id in (7, 8)").collect()} == {"und"}
    assert toxicity.digest(none, labels).count() == language.digest(none).count() == quality.digest(none).count() == 0


def test_quality_calibrates_on_all_rows(spark):
    rng = random.Random(9)
    junk = lambda: "".join(rng.choice("$%#@ABC xyz1") for _ in range(rng.randrange(5, 90)))
    prose = lambda: "The " + words(rng, rng.randrange(5, 40)) + ". " + junk()[:12]
    texts = ["The one text that many rows share, and it has a few more words. It ends here."] * 2500 + [f() for f in (junk, prose) for _ in range(2500)]
    model = quality.fit(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    raw, offsets = np.concatenate(raw), np.cumsum([0] + [len(r) for r in raw])
    x, p = model.raw_scores(raw, offsets), np.array([model.posterior[c] for c in quality.codes(quality.votes(raw, offsets)).tolist()])
    mean, scale, w = quality.fit_logistic(x[:, None], p)
    assert model.calibration == pytest.approx((w[0] - w[1] * mean[0] / scale[0], w[1] / scale[0]), rel=1e-3)


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = [("idiot", False, 2.0), ("scum", False, 1.0), ("abab", True, 1.5), ("trash", False, 3.0)]
    automaton = toxicity.Automaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(prev, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(prev[j] + 1, out[-1] + 1, prev[j - 1] + (x != y)))
        return out

    pool = ["idiot", "idot", "id1ot", "iidiot", "idiots", "idioots", "scum", "scam", "ababa", "aba", "trash", "trsh", "trasch", "rash"] + ["".join(rng.choice("idotrash") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    text = " ".join(pool)
    cp = np.frombuffer(text.encode("utf-16-le"), np.uint16)
    starts = np.cumsum([0] + [len(w) + 1 for w in pool])[:-1]
    word, _, _ = automaton.run(cp, starts, starts + [len(w) for w in pool])
    want = {k for k, w in enumerate(pool) if any(w.startswith(t) if stem else distance(w, t) <= toxicity.Automaton.distance(t, stem) for t, stem, _ in terms)}
    assert set(word.tolist()) == want


def test_held_out_accuracy(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = language.digest(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95
    good = quality.digest(documents).join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in good]) > 0.9


def test_letters_above_the_basic_plane_and_many_languages(spark):
    rng = random.Random(6)
    letters = [chr(0x4E00 + i) for i in range(560)]
    tongue = lambda k: "".join(rng.choice([*letters[8 * k : 8 * k + 8], " "]) for _ in range(150))
    rows = [(70 * i + k, tongue(k), f"l{k:02}") for i in range(8) for k in range(70)]
    rows += [(9001, "\U00010330\U00010331\U00010332" * 3, None), (9002, "\U00020BB7" * 3, None), (9003, "12 \U0001F600 !", None), (9004, None, None)]
    found = {r["doc_id"]: r for r in language.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert np.mean([found[i]["lang_pred"] == lang for i, _, lang in rows[:560]]) > 0.97
    assert found[9001]["lang_pred"] != "und" != found[9002]["lang_pred"] and found[9003]["lang_pred"] == found[9004]["lang_pred"] == "und"


def test_lexicon_of_many_terms_keeps_whole_words(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(n))
    bad, long = [word(7) for _ in range(250)], "w" + "xyz" * 15
    plain = lambda: " ".join(rng.choice(["aa", "ee", "oo", "iou", "uia", "eau"]) for _ in range(30))
    toxic = [f"{plain()} {b} {long} {plain()} {rng.choice(['idiot', 'idiots'])}" for b in bad for _ in range(7)]
    sample = spark.createDataFrame([(t, 1) for t in toxic] + [(plain(), 0) for _ in toxic], "text string, y int")
    terms = toxicity.learn_lexicon(sample)
    assert {b for b in bad} | {"idiot", "idiots", long} <= {t for t, stem, _ in terms if not stem} and len(terms) > 2 * toxicity.AUTOMATON_TERMS
    cases = [*bad, *(b[:3] + "a" + b[4:] for b in bad), "idi0t", "\U00010330idiot", long, long[:-1] + "a", "aa", "eau"]
    cp = np.frombuffer(" ".join(cases).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(c) + 1 for c in cases]) - 1
    hit = toxicity.Lexicon(terms).run(cp, ends - [len(c) for c in cases], ends)[0]
    assert set(hit.tolist()) == set(range(len(cases) - 2))


def test_a_misspelled_term_alone_makes_a_text_toxic(spark):
    rng = random.Random(3)
    plain = lambda: " ".join(rng.choice(["aa", "eeoo", "ooi", "iou", "uia", "eau"]) for _ in range(25))
    rows = [(i, plain() + (" you wretchedfool " if i % 4 == 0 else " ") + plain()) for i in range(400)]
    odd = [(1000, plain() + " you wretchedf00l " + plain()), (1001, plain() + " you wretchetfool " + plain()), (1002, plain())]
    documents = spark.createDataFrame(rows + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.digest(documents, labels).collect()}
    assert all(found[i] == (i % 4 == 0) for i in range(400)) and found[1001] == 1 and found[1002] == 0


def test_minimum_cut_is_least():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 8)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        links = [(i, j, rng.random()) for i in range(n) for j in range(i + 1, min(n, i + 3))]
        cost = lambda labels: sum(abs(s) for s, l in zip(scores, labels) if (s > 0) != l) + sum(w for i, j, w in links if labels[i] != labels[j])  # noqa: B023, E731
        least = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(html_extract.minimum_cut(scores, links)) == pytest.approx(least)


def test_main_text(spark):
    page = "<html><nav><a href=x>Menu</a></nav><div class=content><h1>T &amp; t</h1><p>First   words\nhere, and some more of them.<p>Second.</div><div class='comments'><p>Nice post, thank you very much.</div><script>'<p>no</p>'</script><footer>Copyright, all rights reserved.</footer>"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p <b>x"), (5, "z", "<a href=\"x>y")], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html_extract.extract(pages, ["page_id", "url"]).collect()}
    assert out[1] == "T & t\nFirst words here, and some more of them.\nSecond." and out[2] == out[3] == ""


def test_only_the_cut_gives_the_right_text():
    """Short lines between paragraphs are content, long ones between menu entries are not."""
    long = "A whole sentence of text, with a comma, that is long enough to be content by itself."
    page = f"<body><div><a href=a>One</a></div><div><a href=b>Two</a></div><div>An entry of rather many words that stands among links in a list of links and, with all these words, looks like text.</div><div><a href=c>Three</a></div><div><a href=d>Four</a></div><article><h1>Head</h1><p>{long}</p><div>x</div><p>{long}</p><div>y z</div><p>{long}</p></article>"
    items = html_extract.blocks(page)
    alone = [html_extract.preference(b) > 0 for b in items]
    assert [b.text for b, k in zip(items, alone) if k] != html_extract.main_text(page).split("\n")
    assert html_extract.main_text(page) == "\n".join(["Head", long, "x", long, "y z", long])


def test_hostile_pages_take_linear_time():
    n = 60_000
    started = time.time()
    for page in ("<div>some words here " * n, '<a "' * n, "<a \">\" " * n + "'", "<b>x</i><p>" * n, "</p></div>" * n, "<!--" * n, "<p>x<script>" * n, "<" * n):
        html_extract.main_text(f"<article>{page}")
    assert time.time() - started < 90
    text = "A sentence, which has a few words more than one line, and which ends here."
    assert html_extract.main_text(f"<article><h1>T here.</h1><title-bar/><p>{text}</p><math><mi>x</mi></math><noscript>{text}</noscript></article>") == f"T here.\n{text}\nx {text}".replace("x A", "xA")


def test_pages_of_the_table(spark):
    """On these pages the article element holds the main text and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    moved = total = 0
    for row in html_extract.extract(pages, ["page_id", "html"]).collect():
        items = html_extract.blocks(row["html"] or "")

        def inside(e):
            return e is not None and (e.tag == "article" or inside(e.parent))

        assert row["text"] == "\n".join(b.text for b in items if inside(b.element)) and row["n_chars"] == len(row["text"])
        scores = [html_extract.preference(b) for b in items]
        moved += sum((x > 0) != k for x, k in zip(scores, html_extract.minimum_cut(scores, html_extract.edges(items))))
        total += len(items)
    assert 0 < moved < total / 10


def test_nearest(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 12)) * rng.uniform(0.5, 2, (600, 1))
    x[5:25] = x[4]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1001, [0.0] * 12, 0), (1002, [float("nan")] * 12, 0), (1020, [None] * 12, 0), (None, x[0].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = ann.nearest(table, table.where("vec_id % 20 = 0"), 20, shard_rows=250).toPandas()
    recall = []
    for q, g in found.groupby("query_id"):
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(600), -np.round(s, 9))) if i != q][:20]
        assert list(g.sort_values("rank")["rank"]) == list(range(1, 21)) and q not in set(g["vec_id"])
        recall.append(len(set(want) & set(g["vec_id"])) / 20)
    assert len(recall) == 30 and np.mean(recall) > 0.95
    assert ann.nearest(table.where("false"), table.where("false")).count() == 0


def test_every_node_is_reachable():
    rng = np.random.default_rng(1)
    for points in (np.eye(200), np.column_stack([np.eye(70), np.ones(70)]), rng.normal(size=(300, 4)), np.concatenate([rng.normal(size=(150, 3)), 1e6 + rng.normal(size=(150, 3))])):
        graph, entry = ann.build_graph(ann._lifted(points))
        seen, front = {entry}, [entry]
        while front:
            front = [int(y) for x in front for y in graph[x] if y >= 0 and int(y) not in seen and not seen.add(int(y))]
        assert len(seen) == len(points)


def test_clashing_names(spark, docs):
    """Extra columns named as the operators' own come through with their values."""
    names = ["_h1", "_h2", "_p", "_r", "h1", "h2", "n", "first", "_source", "_block", "_n", "_rank", "_start", "_key", "_h"]
    odd = docs
    for k, c in enumerate(names):
        odd = odd.withColumn(c, F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    want = Counter(tuple(r) for r in odd.select("doc_id", *names).collect())
    for out in (mixing.mix(odd), mixing.mixed_order(odd), sharding.shard(odd, 3, ["doc_id", "text"]), suffix_dedup.remove_repeats(odd)):
        assert Counter(tuple(r) for r in out.select("doc_id", *names).collect()) == want


def test_pipeline_stages(spark, tmp_path):
    """Every stage on a small table with nulls, repeats, near copies and clashing names."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(2)
    base = words(rng, 80)
    item = " ".join(f"q{k}" for k in range(20))
    texts = [base, base, base + " more", words(rng, 50), item + " " + words(rng, 10), None, "", "", words(rng, 40)] + [words(rng, 30) for _ in range(20)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 0) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[0]], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: sorted(r["doc_id"] for r in seen[name])
    assert ids("toxicity") == sorted([*range(29), 0])
    assert ids("near_duplicates") == [i for i in range(29) if i not in (1, 2)]
    assert ids("decontamination") == [i for i in range(29) if i not in (1, 2, 4)] == ids("mixing") == ids("sharding")
    places = {r["doc_id"]: r["mixture_slot"] for r in seen["sharding"]}
    assert sorted(places.values()) == list(range(26))
    want = mixing.mix(spark.read.parquet(f"{tmp_path}/decontamination")).orderBy("slot", "in_block").collect()
    assert [r["doc_id"] for r in want] == sorted(places, key=places.get)
    assert Counter(r["shard"] for r in seen["sharding"]).most_common(1)[0][1] == 1
    assert Counter(map(tuple, pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(tuple, seen["sharding"]))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_states_the_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert Counter(result.fetchall()) == Counter(tuple(r) for r in queries.QUERIES[name](spark, SF).select(columns).collect())
