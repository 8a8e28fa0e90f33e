"""Scores, rates, digests and predictions against plain versions that share no code with the operators' fast paths."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.llm import jaccard, langid, lines, media, mixing, neighbours, quality, queries, toxicity
from papyrine.llm.common import table

SMALL, SF, LARGE = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))
CLASH = "doc_id long, text string, source string, lang string, n_chars string, n_lines int, removed_lines int, d long, h string, gone string, row string, key int, copies int, copy int, root long, first string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank and long texts, ties, repeated rows, ids with two texts, and columns named as the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(20000))
    rows = [(1, None, None, None), (2, "", "a", "en"), (3, " \n\t ", "a", "en"), (4, "one two", "b", "en"), (4, "three four five six seven eight", "b", None), (5, "One TWO", "b", "de"), (6, long, "b", "de"), (6, long, "b", "de"), (None, "x y z", None, None), (None, "X y z", None, None)]
    return spark.createDataFrame([(*r, "n", 7, 8, 9, "h", "g", "r", 1, 2, 3, 4, "f") for r in rows], CLASH)


def test_neighbours_recall_on_a_table(spark):
    """The query's neighbours against brute force over all vectors of sf0.1, for every query."""
    v = table(spark, LARGE, "embeddings").select("vec_id", "embedding").toPandas()
    a, ids = np.array([np.array(x, float) for x in v.embedding]), v.vec_id.to_numpy()
    got = collections.defaultdict(dict)
    for r in queries.op2_neighbours(spark, LARGE).collect():
        got[r.query_id][r.vec_id] = (r.rank, r.score)
    asked = [int(i) for i in ids if i % 100 == 0]
    hits = 0
    for q in asked:
        d = np.sqrt(((a - a[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        hits += len({int(ids[i]) for i in best} & got[q].keys())
        assert sorted(r for r, _ in got[q].values()) == list(range(1, 11))
        assert all(s == pytest.approx(d[ids == i][0], abs=1e-12) for i, (_, s) in got[q].items())
    assert set(got) == set(asked) and hits / (10 * len(asked)) >= 0.9


def test_neighbours_far_cells_are_pruned_and_right(spark):
    """Vectors in far clumps, many cells: exact with factor 1, and identical vectors tie by id."""
    random.seed(4)
    rows = [(i, [100.0 * (i % 7) + random.random(), float(i % 3) + random.random(), 1.0]) for i in range(700)] + [(1000 + i, [3.0, 3.0, 3.0]) for i in range(300)]
    v = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    ids, a = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = collections.defaultdict(list)
    for r in neighbours.search(v, v.filter("id % 50 = 0"), 5, 1.0, shard=40, block=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in ids[ids % 50 == 0]:
        d = np.sqrt(((a - a[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        assert got[q] == [int(ids[i]) for i in np.lexsort((ids, d))[:5]]


def test_toxicity_scores_equal_plain_ones(spark):
    """Every word against every term by dynamic programming, windows by hand."""
    model = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert model.terms
    allowed = lambda t: 0 if len(t) < 5 else 1 if len(t) < 9 else 2

    def best(word):
        found = []
        for term, stem in model.terms:
            if not stem and abs(len(word) - len(term)) > 2:
                continue
            row = list(range(len(term) + 1))
            ends = []
            for i, c in enumerate(word[: len(term) + 2] if stem else word, 1):
                row, last = [i], row
                for j, t in enumerate(term, 1):
                    row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (t != c)))
                ends.append(row[-1])
            least = min(ends) if stem else ends[-1]
            if least <= allowed(term):
                found.append((least, "stem" if stem else "word", term))
        return min(found, default=None)

    memory = {}

    def plain(text):
        words = [(m.group(), *m.span()) for m in toxicity.TOKEN.finditer(text)]
        hits = []
        for k, (w, a, b) in enumerate(words):
            low = w.lower()
            m = memory[low] if low in memory else memory.setdefault(low, best(low))
            if m and not (m[0] and low in model.known):
                marked = a > 0 and b < len(text) and text[a - 1] in toxicity.QUOTES and text[b] in toxicity.QUOTES
                hits.append((k, 2 * (m[0] > 0) + (m[1] == "stem"), marked or any(x.lower() in toxicity.REPORTING for x, _, _ in words[max(0, k - 3) : k])))
        x = [0] * 10
        for k, kind, quoted in hits:
            x[1 + kind + 4 * quoted] += 1
            x[9] += not quoted and any(0 < abs(k - o) <= 3 for o, _, _ in hits)
        z = model.weights[0] + sum(w * math.log2(1 + min(n, 7)) for w, n in zip(model.weights[1:], x[1:]))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    random.seed(8)
    terms = [t for t, _ in model.terms]
    made = ["", "no hit at all"] + [" ".join(random.choice(["so", "the word", '"', "you", t, t[1:], t[:2] + "x" + t[3:], t + "en", t.upper()]) for _ in range(12)) for t in random.sample(terms, min(12, len(terms)))]
    some = made + [r.text for r in table(spark, SMALL, "documents").select("text").collect() if r.text and len(r.text) < 600][:40]
    got = toxicity.score(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), model).collect()
    assert {r.doc_id: pytest.approx(r.score, abs=1e-9) for r in got} == dict(enumerate(map(plain, some)))


def test_mixing_equals_plain_solver(spark):
    """Rates by bisection of each source's one equation; copies round them, and add up to them."""
    got = collections.defaultdict(list)
    docs = table(spark, SF, "documents")
    for r in mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        got[r.source].append(r)
    for rows in got.values():
        sizes, target = np.array([r.size for r in rows], float), rows[0].target
        assert {r.source_size for r in rows} == {sizes.sum()}
        c = sizes / sizes.mean()
        if target < 2 * sizes.sum():
            lo, hi = -64.0, 64.0
            for _ in range(200):
                tilt = (lo + hi) / 2
                lo, hi = (tilt, hi) if (2 / (1 + np.exp(-tilt * c)) * sizes).sum() < target else (lo, tilt)
            rates = np.where(sizes > 0, 2 / (1 + np.exp(-lo * c)), 1)
        else:
            rates = np.where(sizes > 0, 2.0, 1)
        assert np.abs(np.array([r.rate for r in rows]) - rates).max() < 1e-4
        copies = np.array([r.copies for r in rows])
        assert ((copies == np.floor(rates + 1e-4)) | (copies == np.ceil(rates - 1e-4))).all() and abs((copies - rates)[sizes > 0].sum()) <= 1
        assert all(r.taken == r.copies * r.size for r in rows)
    with pytest.raises(RuntimeError):
        sizes = table(spark, SF, "documents").select("source", mixing.word_count(F.col("text")).alias("size"))
        mixing.solve_tilts(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), mixing.source_targets(sizes), steps=1)


def test_media_equals_plain_bytes(spark):
    """Every document of a table, the longest too: bytes, digests and features from the text itself."""
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    assert max(map(len, texts.values())) > 30_000
    rows = queries.op6_media(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        padded = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.caption, r.pos) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), f"text of {len(raw)} bytes", 0)
        counts = collections.Counter(b >> 4 for b in padded)
        mean = sum(padded) / len(padded)
        dev = math.sqrt(sum((b - mean) ** 2 for b in padded) / len(padded)) if len(padded) < 20_000 else None
        said = dict(x.split("=") for x in r.feature.split(";")[1:])
        assert r.feature.split(";")[0] == f"64x{len(padded) // 64}" and float(said["mean"]) == pytest.approx(mean, abs=6e-4) and (dev is None or float(said["dev"]) == pytest.approx(dev, abs=6e-4))
        assert said["hist"] == ",".join(str(counts[k] * 1000 // len(padded)) for k in range(16))


def test_media_sequences_keep_order_and_captions(spark):
    """For every document of a table a page of texts and pictures of other documents; order, captions and payloads stay together."""
    docs = table(spark, SF, "documents").select("doc_id", "text")
    _, stored = media.store(docs)
    features = media.media_features(stored)
    known = {r.digest: r.n_bytes for r in features.collect()}
    digests = sorted(known)
    plan = {d: [(k, digests[(d * 7 + k) % len(digests)] if k % 3 else None) for k in range(d % 6)] for d in range(300)}
    page = lambda d: "".join(f"<p>text {d}.{k}</p>" if ref is None else f'<figure><img src="sha256:{ref}"><figcaption>cap {d}.{k}</figcaption></figure>' for k, ref in plan[d])
    pages = spark.createDataFrame([(d, page(d)) for d in plan], "doc_id long, html string")
    whole = {r.doc_id: r["items"] for r in media.assemble(media.resolve(media.sequences(pages, "doc_id"), "doc_id", features), "doc_id").collect()}
    for d, want in plan.items():
        got = [(i.pos, i.text or i.caption, i.n_bytes) for i in whole.get(d, [])]
        assert got == [(k, f"text {d}.{k}" if ref is None else f"cap {d}.{k}", known.get(ref)) for k, ref in want]


def test_quality_equals_plain_forward_pass(spark):
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    kinds = dict.fromkeys(map(ord, "abcdefghijklmnopqrstuvwxyz"), 0) | dict.fromkeys(map(ord, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 1) | dict.fromkeys(map(ord, "0123456789"), 2) | {32: 3, 10: 4} | dict.fromkeys(map(ord, ".,;:'"), 5) | dict.fromkeys(map(ord, "!?"), 6) | dict.fromkeys(map(ord, "|/\\_-+=~"), 7) | dict.fromkeys(map(ord, "#$%&*@^"), 8) | dict.fromkeys(map(ord, "()[]{}<>\"`"), 9)

    def vectors(text):
        raw = text.encode()
        if not raw:
            return [[0.0] * quality.FEATURES]
        begins = [i for i in range(len(raw)) if raw[i : i + 1].strip(b" \t\n\r\x0b\x0c") and (i == 0 or not raw[i - 1 : i].strip(b" \t\n\r\x0b\x0c"))]
        cuts = [0, *begins[64::64], len(raw)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            part = raw[a:b]
            n = [0] * 12
            for o in part:
                n[10 if o > 127 else kinds.get(o, 11)] += 1
            w = part.split()
            m = max(1, len(w))
            buckets = collections.Counter(zlib.crc32(x) % quality.BUCKETS for x in w)
            out.append([math.sqrt(x / len(part)) for x in n] + [len(set(w)) / m, sum(x == y for x, y in zip(w, w[1:])) / m, math.log1p(len(part) / m) / 3, n[1] / max(1, n[0] + n[1]), min(1, (n[6] + n[8]) / m), min(1, n[7] / m), math.log1p(m) / 5] + [math.sqrt(buckets[k] / 64) for k in range(quality.BUCKETS)])
        return out

    def plain(text):
        p, pooled, weights = model.parts, [], []
        for x in vectors(text):
            h = [math.tanh(sum((v - mu) / s * w for v, mu, s, w in zip(x, model.mean, model.spread, col)) + b) for col, b in zip(p["W"].T.tolist(), p["b"].tolist())]
            gate = [math.tanh(sum(a * v for a, v in zip(h, vc))) / (1 + math.exp(-sum(a * u for a, u in zip(h, uc)))) for vc, uc in zip(p["V"].T.tolist(), p["U"].T.tolist())]
            weights.append(math.exp(sum(g * w for g, w in zip(gate, p["w"].tolist()))))
            pooled.append(h)
        z = sum(w / sum(weights) * sum(c * a for c, a in zip(p["c"].tolist(), h)) for w, h in zip(weights, pooled)) + float(p["d"][0])
        return 1 / (1 + math.exp(-z))

    some = ["", "  \n ", "one", "a\tb\r\nC! " * 200, "\t".join(f"w{i}" for i in range(500))] + [r.text for r in table(spark, SMALL, "documents").select("text").collect() if r.text and len(r.text) < 4000][:30]
    assert len(quality.passages(some[4])) == 8
    got = quality.score(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), model).collect()
    assert {r.doc_id: pytest.approx(r.score, abs=1e-3) for r in got} == dict(enumerate(map(plain, some)))


def test_language_equals_plain_decoding(spark):
    model = langid.train(table(spark, SF, "documents"))
    mask = (1 << 32) - 1

    def plain(text):
        low = [32, 32] + [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in text or ""] + [32]
        if all(c == 32 for c in low):
            return "und", 0.0
        grams = collections.Counter()
        for x, y, z in zip(low, low[1:], low[2:]):
            one, two = z * 0x9E3779B1 & mask, y * 0x85EBCA6B & mask
            if z != 32:
                grams[one >> 20] += 1
            if y != 32 or z != 32:
                grams[((one ^ two) * 0x27D4EB2F & mask) >> 20] += 1
                grams[((((one ^ two) + x * 0xC2B2AE35) & mask ^ 0x165667B1) * 0x9E3779B1 & mask) >> 20] += 1
        length = math.sqrt(sum(grams.values()))
        margins = [sum(math.sqrt(n) / length * model.weights[g, b] for g, n in grams.items()) + model.weights[-1, b] for b in range(model.weights.shape[1])]
        loss = [sum(t * math.log1p(math.exp(-m * c)) for t, m, c in zip(model.trust, margins, code)) / sum(model.trust) for code in model.codes]
        share = [math.exp(-4 * (x - min(loss))) for x in loss]
        return model.langs[loss.index(min(loss))], max(share) / sum(share)

    some = [None, "", "12 !?", "Straße", "ÀÉ déjà vu", "x", "the of and that"] + [r.text for r in table(spark, SMALL, "documents").select("text").collect() if r.text and len(r.text) < 3000][:60]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(some):
        want = plain(text)
        assert got[k][0] == want[0] and got[k][1] == pytest.approx(want[1], abs=1e-6)


def test_language_codes_for_many_languages():
    """Random codes: words far apart, no bit the same for all, and nine made-up languages told apart."""
    for n in (2, 4, 6, 7, 9, 20):
        codes = langid.codewords(n)
        apart = [(codes[i] != codes[j]).sum() for i in range(n) for j in range(i)]
        assert len({tuple(c) for c in codes}) == n and min(apart) >= (1 if n < 7 else 8) and (np.abs(codes.sum(0)) < n).all()
    random.seed(3)
    alphabets = ["".join(random.sample("abcdefghijklmnopqrstuvwxyz", 9)) for _ in range(9)]
    made = lambda k: " ".join("".join(random.choice(alphabets[k]) for _ in range(6)) for _ in range(30))
    known = [(made(k), f"l{k}") for k in range(9) for _ in range(25)]
    model = langid.fit(np.array([langid.features(t) for t, _ in known]), [a for _, a in known])
    fresh = [(made(k), f"l{k}") for k in range(9) for _ in range(10)]
    assert np.mean([p[0] == a for p, (_, a) in zip(model.predict([t for t, _ in fresh]), fresh)]) > 0.97


def test_line_dedup_keeps_what_is_a_rows_own(spark):
    """A row that repeats another's doc_id keeps its own text; a null doc_id comes last."""
    p, u = (" ".join(f"{c}{i}" for i in range(60)) for c in "pu")
    docs = spark.createDataFrame([(1, p), (7, p), (7, u), (None, u), (9, f"own line\n{p}\nlast line")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.text) for r in lines.dedup_passages(docs).collect())
    assert got == sorted([(False, 1, p), (False, 7, ""), (False, 7, u), (True, None, ""), (False, 9, "own line\nlast line")])


def test_near_duplicates_by_rows(spark):
    words = [f"w{i}" for i in range(100)]
    a, b = " ".join(words), " ".join([*words[:50], "x", *words[51:]])
    docs = spark.createDataFrame([(5, a), (5, "quite another text of some words"), (None, b), (3, b), (None, "alone"), (8, "quite another text of some words")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {(5, 96, 3), (3, 96, 3), (None, 96, 3), (5, 2, 5), (8, 2, 5), (None, 1, None)}


def test_operators_and_stages_on_odd_rows(spark, odd):
    import corpus_pipeline as p

    for docs, n in ((odd, 10), (odd.limit(0), 0)):
        done = lines.dedup_passages(docs)
        assert done.columns == [*odd.columns, "n_lines_", "removed_lines_"] and done.count() == n
        assert jaccard.near_duplicates(docs).count() == n and mixing.mix(docs).count() == n
        for name, stage in p.STAGES[:-1]:
            after = stage(spark, docs, SMALL)
            assert after.columns == odd.columns and after.schema.simpleString() == odd.schema.simpleString(), name
            assert after.count() <= 2 * n
        assert p.STAGES[-1][1](spark, docs, SMALL).count() == n
    left = collections.Counter((r.doc_id, (r.text or "")[:9]) for r in p.one_of_each(spark, odd, SMALL).collect())
    assert left == {(1, ""): 1, (2, ""): 1, (3, " \n\t "): 1, (4, "one two"): 1, (4, "three fou"): 1, (6, "w0 w1 w2 "): 2, (None, "x y z"): 1} or left == {(1, ""): 1, (2, ""): 1, (3, " \n\t "): 1, (4, "one two"): 1, (4, "three fou"): 1, (6, "w0 w1 w2 "): 2, (None, "X y z"): 1}
