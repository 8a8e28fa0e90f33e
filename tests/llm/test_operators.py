"""The training-data operators against brute force, other libraries, round trips and held-out labels, and their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.llm import bpe, jaccard, langid, lines, media, mixing, neighbours, quality, queries, toxicity, url_filter
from papyrine.llm.common import remainder, table
from tests.compare import compare

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string, lang string, row string, h int"


def documents(spark, rows):
    """documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank and long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(20000))
    return documents(spark, [(1, None, None, None), (2, "", "a", "en"), (3, " \n\t ", "a", "en"), (4, "one two", "b", "en"), (5, "One TWO", "b", "de"), (6, long, "b", "de"), (6, long, "b", "de"), (None, "x y z", None, None)])


def test_url_filter_matches_sql(spark):
    assert compare(spark, SF, queries.op1_url_filter, queries.ORACLES["op1_url_filter"]) == ""


def test_url_filter_edges_and_levels(spark):
    urls = [None, "", "no scheme.net/", "http://NET/", "http://net", "http://a.net?x=/", "https://b.example.net/en/x#y", "http://xnet/", "http://q.org/fr/a", "ftp://u:80/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, queries.RULES, false_rate=0.9).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("net", "/", "net/", "block") and got[4] == ("net", "", None, "allow") and got[5] == ("a.net", "", None, "allow")
    assert got[6] == ("b.example.net", "/en/x", "example.net/en/", "allow") and got[7][2] is None and got[8][2] == "org/fr/"
    assert url_filter.judge(pages.limit(0), queries.RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_cascade_is_exact_with_many_false_positives(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter(F.crc32("key") % 7 == 0)
    c = url_filter.cascade(listed, universe, false_rate=0.3)
    assert len(c.levels) > 2
    assert universe.filter(c.holds(F.col("key")) != (F.crc32("key") % 7 == 0)).count() == 0


def test_cascade_over_millions_of_keys(spark):
    """Few listed keys in a universe of 3 million: levels stay small, and false positives of the first one are caught."""
    universe = spark.range(3_000_000).select(F.concat(F.lit("host"), "id", F.lit(".net/")).alias("key"))
    listed = universe.filter("key IN ('host7.net/', 'host2999999.net/')")
    c = url_filter.cascade(listed, universe)
    assert sum(len(v.words) for v in c.levels) <= 200 and len(c.levels) <= 6
    assert sorted(r.key for r in universe.filter(c.holds(F.col("key"))).collect()) == ["host2999999.net/", "host7.net/"]
    many = url_filter.cascade(universe.filter("crc32(key) % 1000 = 0"), universe, false_rate=0.2)
    assert len(many.levels) >= 2 and universe.filter(many.holds(F.col("key")) != (F.crc32("key") % 1000 == 0)).count() == 0


def test_neighbours_exact_and_recall(spark):
    v = neighbours.usable(table(spark, SF, "embeddings"), "vec_id", "embedding")
    p = v.toPandas()
    a, ids = np.stack(p.v), p.id.to_numpy()
    want = {}
    for i in ids[ids % 50 == 0]:
        d = np.sqrt(((a - a[ids == i][0]) ** 2).sum(1))
        d[ids == i] = np.inf
        want[int(i)] = [int(x) for x in ids[np.lexsort((ids, d))[:10]]]
    for factor, least in ((1.0, 1.0), (queries.NEAR_FACTOR, 0.9)):
        got = collections.defaultdict(list)
        for r in neighbours.search(v, v.filter("id % 50 = 0"), 10, factor, shard=100, block=4).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        assert np.mean([len(set(got[i]) & set(w)) / len(w) for i, w in want.items()]) >= least
        assert factor > 1 or got == want


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [0.0, 1.0])]
    v = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(v, v.filter("id = 0"), 10).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 7)]
    assert neighbours.search(v.limit(0), v.limit(0)).count() == 0


def test_bpe_equals_tiktoken(spark, odd):
    import tiktoken

    lines_ = queries.vocabulary()
    ranks = bpe.read_ranks(lines_)
    ref = tiktoken.Encoding("ref", pat_str=queries.pattern(), mergeable_ranks=ranks, special_tokens={})
    random.seed(3)
    texts = ["", "don't I'LL", "\x1c a\x85b\xa0 c  \n\n x", "日本語 😀", "a" * 3000, " " * 999, "".join(chr(random.randrange(1, 0xD7FF)) for _ in range(3000))]
    texts += ["".join(random.choice("ab \n\t'sré1٣ \x1f ") for _ in range(40)) for _ in range(200)]
    c = bpe.Codec(lines_, queries.pattern(), cached=50)
    for t in texts:
        ids = ref.encode_ordinary(t)
        assert c.encode(t) == ids and c.decode(ids) == t.encode()
    got = {r.doc_id: r for r in bpe.encode_digests(odd, lines_, queries.pattern()).collect()}
    assert got[1].n_tokens == 0 and got[1].ids_sha256 == got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.decode(bpe.encode(odd, lines_, queries.pattern()), lines_, queries.pattern()).filter("doc_id = 4").first().text == "one two"
    assert bpe.encode_digests(odd.limit(0), lines_, queries.pattern()).count() == 0


def test_mixing_meets_targets(spark, odd):
    rows = mixing.mix(table(spark, SF, "documents")).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.target, r.source_size].append(r)
    assert len(rows) == 1000 and all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    sizes = sum(s for _, s in by)
    assert sum(t for t, _ in by) == pytest.approx(1.5 * sizes)
    assert all(abs(sum(r.taken for r in v) - t) <= 0.02 * t for (t, _), v in by.items())
    again = mixing.mix(table(spark, SF, "documents").repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    got = collections.Counter((r.doc_id, r.size, r.taken) for r in mixing.mix(odd).collect())
    assert got[(1, 0, 0)] == got[(3, 0, 0)] == 1 and sum(got.values()) == 8
    assert mixing.mix(odd.limit(0)).count() == 0


def test_targets_by_resharing(spark):
    rows = [("a", 10), ("b", 1000), ("c", 1000), (None, 50)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    size, weight, left = dict(rows), {"a": 5, "b": 2, "c": 1, None: 5}, 1.5 * 2060
    want, open_ = {}, set(size)
    while full := {s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) >= 2 * size[s]}:
        want |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    want |= {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
    assert got == pytest.approx(want)


def test_media_round_trip(spark, odd):
    pages, stored = media.store(odd)
    items = media.sequences(pages, "doc_id")
    resolved = media.resolve(items, "doc_id", media.media_features(stored))
    for r in resolved.filter("doc_id is not null").collect():
        raw = {1: b"", 2: b"", 3: b" \n\t ", 4: b"one two", 5: b"One TWO"}.get(r.doc_id)
        if raw is not None:
            padded = raw.ljust(64, b"\0")
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), 64, hashlib.sha256(padded).hexdigest(), zlib.crc32(padded))
    assert resolved.count() == 8 and media.assemble(resolved, "doc_id").count() == 7
    html = '<p>a <b>b</b><figure><img src="sha256:' + "0" * 64 + '"><figcaption>c &amp;</figcaption></figure>d<img src=y alt=z><script>x</script>'
    got = [(i["pos"], i["kind"], i["text"], i["caption"]) for i in media.sequence(html)]
    assert got == [(0, "text", "a b", None), (1, "media", None, "c &"), (2, "text", "d", None), (3, "media", None, "z")] and media.sequence(None) == []
    gone = media.resolve(media.sequences(spark.createDataFrame([(1, html)], "doc_id long, html string"), "doc_id"), "doc_id", media.media_features(stored)).orderBy("pos").collect()
    assert [r.payload_bytes for r in gone] == [None] * 4
    with pytest.raises(ValueError):
        media.unpack(media.pack(b"a" * 64)[:-9] + b"x" * 9)


@pytest.mark.parametrize("name,label,held,least", [("op3_toxicity", "toxic", 0, 0.93), ("op7_quality", "quality", 2, 0.97)])
def test_classifiers_on_held_out(spark, name, label, held, least):
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r[label] for r in rows]) >= least and all(0 <= r.score <= 1 for r in rows)


def test_language_on_held_out(spark, odd):
    docs = table(spark, SF, "documents")
    model = langid.train(docs)
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(remainder(F.col("doc_id"), 3) == 1).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    got = {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == "und" != got[4]
    assert {r.lang_pred for r in langid.predict(odd, langid.train(odd.limit(0))).collect()} == {"und"}


def test_classifiers_on_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for m, model in ((quality, quality.train(odd, none)), (toxicity, toxicity.train(odd, none))):
        assert m.score(odd, model).count() == 8 and m.score(odd.limit(0), model).count() == 0
    some = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(1, 7)] + [(2, None, None)], "doc_id long, quality int, toxic int")
    assert quality.keep(odd, quality.train(odd, some), 0.0).count() == 8
    assert toxicity.score(odd, toxicity.train(odd, some)).count() == 8


def test_levenshtein_automaton_equals_brute_force():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    terms = ["idiot", "idle", "stupidity", "abcdefghij"]
    a = toxicity.Automaton([(t, False) for t in terms])
    random.seed(1)
    for _ in range(3000):
        t = list(random.choice(terms))
        for _ in range(random.randrange(4)):
            k = random.randrange(len(t) + 1)
            t[k : k + random.randrange(2)] = random.choice(["", "x", "i", "d"])
        w = "".join(t)
        near = [(distance(w, x), x) for x in terms if distance(w, x) <= a.allowed(x)]
        assert a.match(w) == ((min(near)[0], "word", min(near)[1]) if near else None)


def test_quotation_counts_less():
    random.seed(2)
    said = lambda n: [f"v{random.randrange(400)}" for _ in range(n)]
    abuse = [" ".join([*said(9), w, *said(9)]) for w in ("grumphead", "blaggard") for _ in range(80)]
    m = toxicity.fit(abuse + [" ".join(said(19)) for _ in range(300)], [1] * 160 + [0] * 300)
    assert m.terms == [("blaggard", False), ("grumphead", False)]
    used, quoted, misspelled, clean = map(m.score, ("what a grumphead", 'the word "grumphead" is old', "what a grumpheat", "what a day"))
    assert used >= 0.5 > quoted and clean < 0.5 and used > misspelled > clean == m.score("")


def brute_components(docs):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[d] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = collections.defaultdict(list)
    for d in sorted(sets):
        shared = collections.Counter(e for g in sets[d] for e in inverted[g])
        for e, o in shared.items():
            if 100 * o >= 80 * (len(sets[d]) + len(sets[e]) - o):
                a, b = sorted((find(d), find(e)))
                root[b] = a
        for g in sets[d]:
            inverted[g].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("kw", [{}, {"hot": 30, "block": 4}])
def test_near_duplicates_equal_brute_force(spark, kw):
    """The table's documents, and chains of drifting copies, whose ends link only through the middle."""
    random.seed(5)
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    words = [f"w{i}" for i in range(300)]
    for c in range(3):
        now = random.sample(words, 120)
        for k in range(25):
            now[random.randrange(120)] = random.choice(words)
            rows.append((100_000 + 100 * c + k, " ".join(now)))
    rows += [(200_000, None), (200_001, ""), (200_002, "A b"), (200_003, "a  B"), (200_004, "a b c")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_odd(spark, odd):
    got = [tuple(r) for r in jaccard.near_duplicates(odd).orderBy("doc_id").collect()]
    assert got[1:4] == [(1, 0, 1), (2, 0, 2), (3, 0, 3)] and got[4:6] == [(4, 1, 4), (5, 1, 4)] and len(got) == 8
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0


def test_line_dedup(spark, odd):
    passage = " ".join(f"p{i}" for i in range(60))
    block = "\n".join(" ".join(f"b{j}x{i}" for i in range(12)) for j in range(6))
    rows = [(k, f"start {k} of text\n{passage}\nend {k} here\n{block}\nlast {k}", "s", None) for k in range(1, 5)] + [(9, f"only\n{passage} but not quite\nother", "s", None)]
    got = {r.doc_id: r.text for r in lines.dedup(documents(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[9] == rows[-1][1]
    for k in (2, 3, 4):
        assert passage not in got[k] and f"start {k} of text" in got[k] and f"end {k} here" in got[k] and f"last {k}" in got[k]
    back = lines.dedup(odd)
    assert back.columns[: len(odd.columns)] == odd.columns and back.count() == 8
    assert back.filter("doc_id = 1").first().text is None and lines.dedup(odd.limit(0)).count() == 0


def test_line_dedup_passage_of_short_lines(spark):
    short = [" ".join(f"s{j}x{i}" for i in range(9)) for j in range(12)]
    rows = [(k, "\n".join([f"own {k} line", *short, f"last {k} line"]), "s", None) for k in (1, 2)] + [(3, f"a\n{short[0]}\nb\n\n{short[1]}\nc", "s", None)]
    got = {r.doc_id: r.text for r in lines.dedup(documents(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert sum(s in got[2] for s in short) < 6 and "own 2 line" in got[2] and "last 2 line" in got[2]


def test_line_dedup_whole_passages(spark):
    """Passages of 2 to 8 lines go completely whatever stands around them; own lines and pairs of common lines that meet by chance stay."""
    random.seed(6)
    count = iter(range(10**6))
    line = lambda n: " ".join(f"u{next(count)}" for _ in range(n))
    passages = [[line(random.randrange(-(-51 // n), 40)) for _ in range(n)] for n in (2, 3, 4, 5, 6, 7, 8) for _ in range(12)]
    passages += [[line(9), line(45)], [line(45), line(9)], [line(9), "", line(45), line(8)]]
    common = [line(14) for _ in range(8)]
    rows, want = [], {}
    for d in range(3 * len(passages)):
        p, a, b = passages[d % len(passages)], [line(random.randrange(3, 45)) for _ in range(3)], [line(random.randrange(3, 45)) for _ in range(3)]
        rows.append((d, "\n".join([*a, *p, *b]), "s", None))
        want[d] = rows[-1][1] if d < len(passages) else "\n".join(a + b)
    for d in range(1000, 1008):
        rows.append((d, "\n".join([line(5), common[d % 8], common[d % 8 - 3], line(5)]), "s", None))
        want[d] = rows[-1][1]
    twice = [line(20) for _ in range(3)]
    rows.append((2000, "\n".join([*twice, line(4), *twice, "end"]), "s", None))
    want[2000] = rows[-1][1].split("\n" + twice[0])[0] + "\nend"
    frame = documents(spark, rows)
    assert {r.doc_id: r.text for r in lines.dedup_passages(frame).collect()} == want


def test_line_dedup_query_leaves_no_passage(spark, odd):
    """In the table, every line of a passage that an earlier document holds line by line (over 50 words) is gone, unless it stands elsewhere too."""
    rows = sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").collect())
    got = {r.doc_id: (r.text, r.removed_lines) for r in queries.op9_line_dedup(spark, SF).collect()}
    pairs, single = set(), set()
    for d, t in rows:
        mine = t.split("\n")
        at, k = set(), 0
        while k < len(mine):
            end = k
            while end + 1 < len(mine) and (mine[end], mine[end + 1]) in pairs:
                end += 1
            if len(" ".join(mine[k : end + 1]).split()) > 50 and (end > k or mine[k] in single):
                at |= set(range(k, end + 1))
            k = max(k + 1, end)
        due = [mine[i] for i in sorted(at)]
        left = collections.Counter(got[d][0].split("\n"))
        assert all(left[x] <= mine.count(x) - due.count(x) for x in due), d
        assert got[d][1] == len(mine) - (len(got[d][0].split("\n")) if got[d][0] else 0)
        pairs |= set(zip(mine, mine[1:]))
        single |= set(mine)
    kept = {x for t, _ in got.values() for x in t.split("\n")}
    assert single <= kept | {""}
    back = lines.dedup_passages(odd)
    assert back.columns[: len(odd.columns)] == odd.columns and back.count() == 8 and lines.dedup_passages(odd.limit(0)).count() == 0


def test_line_dedup_equals_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    first, want = {}, {}
    for d, t in rows:
        for body, _, _ in lines.chunks(t):
            first.setdefault(body, d)
    for d, t in rows:
        parts = lines.chunks(t)
        old = [first[p[0]] != d or p[0] in {q[0] for q in parts[:k]} for k, p in enumerate(parts)]
        kept, k = [], 0
        while k < len(parts):
            end = k
            while end < len(parts) and (old[end] if parts[end][2] else end > k):
                end += 1
            many, words = sum(p[1] for p in parts[k:end]), sum(p[2] for p in parts[k:end])
            gone = words >= 40 or (words >= 25 and many > 1)
            kept += [] if gone else [p[0] for p in parts[k:end]]
            if end == k:
                kept.append(parts[k][0])
                end += 1
            k = end
        want[d] = "\n".join(kept)
    assert {r.doc_id: r.text for r in lines.dedup(docs).collect()} == want


def test_mix_stage_keeps_each_rows_decision(spark, odd):
    import corpus_pipeline as p

    got = p.mix_sources(spark, odd, SF)
    want = collections.Counter()
    for r in mixing.mix(odd).collect():
        want[r.doc_id, r.size] += r.copies
    assert got.columns == odd.columns and want[None, 3] == 2
    assert collections.Counter((r.doc_id, len((r.text or "").split())) for r in got.collect()) == +want
    words = lambda s, k: " ".join(f"{s}{k}x{i}" for i in range(10))
    rows = documents(spark, [(k, words("a", k), "a", None) for k in range(20)] + [(7 if k % 2 else None, words("b", k), "b", None) for k in range(40)])
    taken = collections.Counter(r.text for r in p.mix_sources(spark, rows, SF).collect())
    assert [taken[words("a", k)] for k in range(20)] == [2] * 20
    assert sum(taken[words("b", k)] for k in range(40)) == 50 and set(taken.values()) == {1, 2}
    again = collections.Counter(r.text for r in p.mix_sources(spark, rows.repartition(3), SF).collect())
    assert again == taken
    assert p.mix_sources(spark, odd.limit(0), SF).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = table(spark, SF, "documents")
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        docs = p.written(after, "test")
        assert 0 < docs.count()
    ids = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert set(ids.values()) <= {1, 2}
    assert p.STAGES[-1][1](spark, docs, SF).count() == sum(ids.values())


def test_pipeline_equals_plain_python(spark, tmp_path):
    """run() on clean documents, junk, passages, exact and near copies; the expected rows come from how they were planted."""
    import corpus_pipeline as p
    import tiktoken

    random.seed(7)
    word = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randrange(4, 10)))
    line = lambda n: " ".join(word() for _ in range(n))
    passages = [[line(random.randrange(-(-51 // n), 40)) for _ in range(n)] for n in (2, 3, 5, 8)]
    docs, left = [], {}

    def add(source, text, after, quality=1):
        docs.append((len(docs), text, "en", source, len(text), quality))
        if after is not None:
            left[docs[-1][0]] = (after, source)

    for k in range(50):
        own, source = [line(random.randrange(8, 45)) for _ in range(6)], "aab"[k % 3]
        if k < 12:
            add(source, "\n".join([*own[:3], *passages[k % 4], *own[3:]]), "\n".join(own if k >= 4 else [*own[:3], *passages[k], *own[3:]]))
        else:
            add(source, "\n".join(own), "\n".join(own))
    for k in range(50):
        add("ab"[k % 2], "\n".join(" ".join(f"{word().upper()}!! {random.randrange(999)} ###$" for _ in range(12)) for _ in range(4)), None, 0)
    for k in (1, 20, 33):
        add("b", docs[k][1], None)
    for source in "ab":
        base = [word() for _ in range(120)]
        add(source, " ".join(base), " ".join(base))
        near = " ".join([*base[:60], word(), *base[61:]])
        add(source, near, near)
    alone = brute_components([(d, t) for d, (t, _) in left.items()])
    assert sum(c != d for d, (_, c) in alone.items()) == 2
    left = {d: x for d, x in left.items() if alone[d][1] == d}
    size = {s: sum(len(t.split()) for t, of in left.values() if of == s) for s in "ab"}
    assert size["a"] > size["b"]
    rest = [word() for _ in range(size["a"] - size["b"])]
    padding = "\n".join(" ".join(rest[i : i + 15]) for i in range(0, len(rest), 15))
    add("b", padding, padding)
    # Equal sizes: source a (weight 5 of 7) is full at two copies a document, which leaves one for b.
    ref = tiktoken.Encoding("ref", pat_str=queries.pattern(), mergeable_ranks=bpe.read_ranks(queries.vocabulary()), special_tokens={})
    want = collections.Counter()
    for d, (t, source) in left.items():
        want[d, len(ref.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()] = 2 if source == "a" else 1
    spark.createDataFrame([r[:5] for r in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], r[5], 0) for r in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = collections.Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in p.run(spark, str(tmp_path)).collect())
    assert got == want
