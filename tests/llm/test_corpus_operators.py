"""Deduplication, near duplicates, decontamination, mixing and the pipeline against brute force on small fixtures and edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankloom.llm import decontaminate, exact_dedup, mixing, ngram_jaccard
from rankloom.llm.components import components
from rankloom.llm._common import Stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "te") for b in ("bar", "dan", "fel", "gor", "hin", "jus", "kel", "lam")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = "zz" + rng.choice(WORDS)
    return " ".join(w)


def edge_rows(rng):
    return [(9000, None, None, None, None), (9001, "", "en", "s1", 0), (9002, " \t\n", "en", None, 3), (9003, "two words", "en", "s1", 9), (9004, "Two\twords ", "en", "s1", 10), (9005, prose(rng, 30_000), None, "s2", 0), (None, "no id", "en", "s1", 5), (None, "no id", "en", "s1", 5)]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash")).withColumn("Size", F.lit(1)).withColumn("node", F.lit(2.5))


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    texts = [prose(rng, rng.choice([1, 3, 12, 40, 160])) for _ in range(60)]
    for t in texts[:20]:
        texts += [t, t.replace(" ", "  "), edited(rng, t, 1), edited(rng, t, 2), t.upper()]
    base = prose(rng, 150)
    texts += [base] * 40 + [edited(rng, base, rng.randrange(1, 7)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + edge_rows(rng) + rows[:3]


def smallest(ids):
    return min(ids, key=lambda i: (i is None, i or 0))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)])
def test_exact_dedup_equals_a_plain_loop(spark, corpus, digest):
    """With a digest of one letter, most hits differ in their bytes."""
    groups = {}
    for i, t, *_ in corpus:
        groups.setdefault(normal(t), []).append(i)
    got = exact_dedup.decide(docs_of(spark, corpus), digest=digest).collect()
    want = sorted((str(i), str(smallest(groups[normal(t)])), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t, *_ in corpus)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.filter_documents(docs_of(spark, corpus))
    assert kept.columns == docs_of(spark, corpus).columns
    assert sorted(normal(r.text) for r in kept.collect()) == sorted(groups)


def test_exact_dedup_goes_on_from_its_state(spark, corpus, tmp_path):
    """Three runs over parts of the rows, the last two over the state of those before, report what one run over all does, each of its own rows."""
    rows = sorted({(r[0], *r[1:]) for r in corpus if r[0] is not None}, key=lambda r: r[0])  # later runs have larger ids, so no kept row is overtaken
    docs_of(spark, rows).write.parquet(f"{tmp_path}/all")
    whole = {(r.doc_id, r.keep_id, r.kept, r.text_sha256) for r in exact_dedup.report(spark.read.parquet(f"{tmp_path}/all")).collect()}
    got, at = set(), f"file://{tmp_path}/state"
    for n, (a, b) in enumerate([(0, 90), (90, 91), (91, 10**6)]):
        part = docs_of(spark, rows[a:b])
        if n != 1:  # the second run's rows lie in no file
            part.write.parquet(f"{tmp_path}/part{n}")
            part = spark.read.parquet(f"{tmp_path}/part{n}")
        got |= {(r.doc_id, r.keep_id, r.kept, r.text_sha256) for r in exact_dedup.report(part, state=at).collect()}
    assert got == whole
    # texts that agree in their digest only are told apart from those of earlier runs too
    one = lambda c: F.substring(exact_dedup.sha256(c), 1, 1)
    first = {(r.doc_id, r.kept) for r in exact_dedup.report(spark.read.parquet(f"{tmp_path}/part0"), state=f"{at}-short", digest=one).collect()}
    assert first == {(i, k) for i, _, k, _ in whole if i in {r[0] for r in rows[:90]}}


def test_exact_dedup_in_several_batches(spark, corpus, tmp_path):
    """The log is streamed file by file: state goes on from batch to batch."""
    docs_of(spark, corpus).repartition(7).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = sorted(map(str, exact_dedup.report(docs, files_per_batch=1).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(map(str, exact_dedup.report(docs).collect())) and len(got) == len(corpus)


def test_empty_tables(spark, tmp_path):
    none = docs_of(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    assert exact_dedup.report(none).count() == 0 and exact_dedup.filter_documents(none).count() == 0
    assert ngram_jaccard.report(none, k=3, num=90, den=100).count() == 0 and ngram_jaccard.filter_documents(none).count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def plain_classes(rows, k, num):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    link = list(range(len(rows)))

    def root(x):
        while link[x] != x:
            x = link[x]
        return x

    for x, (_, s) in enumerate(sets):
        for y in range(x):
            u = sets[y][1]
            if s and u and 100 * len(s & u) >= num * len(s | u):
                link[max(root(x), root(y))] = min(root(x), root(y))
    out = {}
    for x, (i, s) in enumerate(sets):
        mine = [sets[y][0] for y in range(len(rows)) if s and root(y) == root(x) and sets[y][1]]
        ids = [m for m in mine if m is not None]
        out.setdefault(i, set()).add((len(s), (min(ids) if ids else i) if s else i))
    return out


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard_classes_equal_all_pairs(spark, corpus, k, num):
    got = ngram_jaccard.report(docs_of(spark, corpus), k=k, num=num, den=100).collect()
    want = plain_classes(corpus, k, num)
    assert len(got) == len(corpus)
    for r in got:
        assert (r.n_shingles, r.component_id) in want[r.doc_id]


def test_near_copies_leave_one_of_each_class(spark, corpus):
    kept = ngram_jaccard.filter_documents(docs_of(spark, corpus), k=5, num=80, den=100)
    want = plain_classes(corpus, 5, 80)
    classes = {c for v in want.values() for n, c in v if n}
    empty = sum(not (t or "").split() for _, t, *_ in corpus)
    assert kept.count() == len(classes) + empty and kept.columns == docs_of(spark, corpus).columns


@pytest.mark.parametrize("block", [512, 3])
def test_tiles_of_unlinked_near_copies(spark, block, monkeypatch):
    """A group whose members are near one another in chains and not all to its least one: tiles must settle it."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    rng = random.Random(8)
    base, rows = prose(rng, 200), []
    for i in range(40):
        t = edited(rng, base, 6)
        rows += [(10 * i + 5, t, "en", "s", 0), (10 * i + 3, edited(rng, t, 1), "en", "s", 0)]
    got = {r.doc_id: r.component_id for r in ngram_jaccard.report(docs_of(spark, rows), k=3, num=90, den=100).collect()}
    assert got == {i: next(iter(v))[1] for i, v in plain_classes(rows, 3, 90).items()}


def test_parts_of_near_sets_meet():
    import numpy as np

    rng = np.random.default_rng(1)
    none = np.zeros(0, np.uint64)
    for num in (80, 90):
        bands = ngram_jaccard.Bands(num, 100)
        for _ in range(400):
            n = int(rng.integers(1, 120))
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 63, int(rng.integers(0, 4)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert set(bands.tiles(a, none).tolist()) & set(bands.tiles(b, none).tolist())
                frequent = np.unique(rng.choice(bands.every(a), 1 + len(a) // 3)) if len(bands.every(a)) else none
                assert set(bands.tiles(a, frequent).tolist()) & set(bands.tiles(b, frequent).tolist())


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long"), Stage(spark, "t"), "c").collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 130)}


def test_decontamination_finds_edited_copies(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, 40)) for i in range(8)] + [(8, "only three words"), (9, None), (10, "")]
    rows, want = [], set()
    for i in range(60):
        t = prose(rng, rng.randrange(1, 300))
        if i % 3 == 0:
            j = rng.randrange(8)
            t = t + " " + edited(rng, items[j][1], rng.randrange(0, 6)) + " " + prose(rng, 30)
            want.add((i, j))
        if i == 1:
            t += " Only three WORDS here"
            want.add((1, 8))
        rows.append((i, t, "en", "s", 0))
    rows += edge_rows(rng)
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id int, text string")
    got = decontaminate.report(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.columns[:2] == ["doc_id", "item_id"]
    kept = decontaminate.filter_documents(docs, bench)
    assert kept.count() == len(rows) - len({i for i, _ in want}) and kept.columns == docs.columns
    assert decontaminate.report(docs, bench.limit(0)).count() == 0 and decontaminate.report(docs.limit(0), bench).count() == 0


def full_alignment(rows, items):
    """(doc_id, item_id): score of every pair that reaches 0.6 in the alignment of the whole text."""
    import numpy as np

    ids = {}
    number = lambda t: np.array([ids.setdefault(w, len(ids)) for w in (t or "").lower().split()], np.uint64)
    out = {}
    for d, t, *_ in rows:
        for i, x in items:
            a = number(x)
            score = decontaminate.smith_waterman(a, number(t))[0] / (2 * len(a))
            if score >= 0.6:
                out[d, i] = round(score, 6)
    return out


def found_scores(docs, bench):
    return {(r.doc_id, r.item_id): r.score for r in decontaminate.report(docs, bench).collect()}


def test_decontamination_finds_copies_split_by_foreign_words(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, 40)) for i in range(4)]
    rows = []
    for n in (10, 14, 15, 20, 24, 28, 30, 31, 32, 33, 36):
        for cut in (10, 20, 33):
            w = rng.choice(items)[1].split()
            filler = [f"zz{rng.randrange(10**6)}" for _ in range(n)]
            rows.append((len(rows), " ".join([prose(rng, 50), *w[:cut], *filler, *w[cut:], prose(rng, 50)]), "en", "s", 0))
    want = full_alignment(rows, items)
    assert 0 < len(want) < len(rows)
    assert found_scores(docs_of(spark, rows), spark.createDataFrame(items, "item_id int, text string")) == want


def test_decontamination_equals_the_full_alignment(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate((4, 5, 6, 16, 24, 40, 60))]
    rows = []
    strange = lambda: f"zz{rng.randrange(10**6)}"
    for _, x in items:
        w = x.split()
        for e in (2, 3, 4):
            replaced = [strange() if j % e == e - 1 else y for j, y in enumerate(w)]
            parted = [v for j, y in enumerate(w) for v in ([y, strange()] if j % e == e - 1 else [y])]
            dropped = [y for j, y in enumerate(w) if j % (e + 2)]
            for c in (replaced, parted, dropped):
                rows.append((len(rows), " ".join([prose(rng, 50), *c, prose(rng, 50)]), "en", "s", 0))
    long = prose(rng, 40_000).split()
    for at, (_, x) in zip((16_370, 33_000), items[-2:]):
        long[at:at] = [v for y in x.split() for v in (y, y if rng.random() < 0.3 else strange())][: 2 * len(x.split()) - 20]
    rows.append((len(rows), " ".join(long), "en", "s", 0))
    want = full_alignment(rows, items)
    assert 0 < len(want) < len(rows) * len(items)
    assert found_scores(docs_of(spark, rows), spark.createDataFrame(items, "item_id int, text string")) == want


def test_decontamination_does_not_depend_on_how_often_an_item_stands(spark):
    """An item's beginning stands in many texts; an edited copy has no other four words in a row."""
    rng = random.Random(10)
    item = [f"w{i}" for i in range(16)]
    copy = [*item[:9], "zz1", *item[10:13], "zz2", *item[14:]]
    rows = [(0, " ".join(["before", *copy, "after"]), "en", "s", 0)]
    rows += [(n, " ".join([prose(rng, 5), *item[:9], prose(rng, 5)]), "en", "s", 0) for n in range(1, 41)]
    want = full_alignment(rows, [(7, " ".join(item))])
    assert set(want) == {(0, 7)}
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id int, text string")
    assert found_scores(docs_of(spark, rows), bench) == found_scores(docs_of(spark, rows[:1]), bench) == want


def test_benchmark_blocks_do_not_change_the_result(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng, 30)) for i in range(6)]
    rows = [(i, prose(rng, 20) + " " + items[i % 6][1], "en", "s", 0) for i in range(12)]
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id int, text string")
    one = sorted(map(tuple, decontaminate.report(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_GRAMS", 50)
    assert sorted(map(tuple, decontaminate.report(docs, bench).collect())) == one and len(one) == 12


def test_smith_waterman_equals_the_full_table():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 4, int(rng.integers(0, 12))).astype(np.uint64), rng.integers(0, 4, int(rng.integers(0, 14))).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.smith_waterman(a, b)[0] == h.max()


def plain_targets(sizes, weights, most):
    """Clamp, then share what is over by weight, until nothing is."""
    total, capped = sum(sizes.values()), {}
    while True:
        left, w = total - sum(capped.values()), sum(weights[s] for s in sizes if s not in capped)
        share = {s: left * weights[s] / w for s in sizes if s not in capped}
        over = [s for s in share if share[s] > most * sizes[s]]
        if not over:
            return share | capped
        capped |= {s: float(most * sizes[s]) for s in over}


def test_mixing_meets_its_targets(spark, corpus):
    rng = random.Random(2)
    rows = list(corpus) + [(20_000 + i, prose(rng, 20), "en", "big", 0) for i in range(200)] + [(30_000, "tiny one", "en", "small", 8)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, of = {}, {}
    for i, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = plain_targets(sizes, {s: k % 3 + 1 for k, s in enumerate(names)}, 3)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    source = {i: s for i, _, _, s, _ in rows}
    for r in got:
        s = source[r.doc_id]
        of.setdefault(s, []).append(r)
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    for s, rs in of.items():
        assert abs(sum(r.taken for r in rs) - want[s]) <= max(r.size for r in rs)
    again = mixing.mix(docs_of(spark, rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_keeps_columns_and_takes_nothing_from_nothing(spark, corpus):
    docs = docs_of(spark, corpus)
    got = mixing.mix(docs, keep_columns=True)
    assert got.columns == [c for c in docs.columns if c != "Size"] + ["size", "source_size", "target", "taken"] and got.count() == len(corpus)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("doc_id in (9000, 9001, 9002)")).agg(F.sum("taken")).first()[0] == 0


def test_the_mix_as_rows(spark, corpus):
    """A row for each time that a row is taken, none for rows not taken."""
    docs = docs_of(spark, list(corpus) + [(20_000 + i, f"big {i} words", "en", "big", 0) for i in range(3000)])
    plan, got = mixing.mix(docs).collect(), mixing.mixed(docs).collect()
    want = sorted((str(r.doc_id), e) for r in plan if r.size for e in range(1, r.taken // r.size + 1))
    assert sorted((str(r.doc_id), r.epoch) for r in got) == want and {r.epoch for r in got} >= {1, 2} and any(r.taken == 0 for r in plan)
    assert sum(r.size for r in got) == sum(r.taken for r in plan) and {"text", "lang", "source", "kept"} <= set(got[0].asDict())


def test_pipeline_stages_take_effect(spark, tmp_path):
    rng = random.Random(21)
    items = [(i, prose(rng, 40)) for i in range(3)]
    rows, labels = [], []
    for i in range(240):
        t = prose(rng, 60)
        if i % 6 == 0:
            t += " scum moron scumbag moron"
        if i % 2 == 0:
            labels.append((i, 1, int(i % 6 == 0)))
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    clean = rows[1]
    rows += [(500, clean[1], "en", "s1", 0), (501, edited(rng, clean[1], 1), "en", "s1", 0), (502, prose(rng, 30) + " " + items[0][1], "en", "s2", 0), (503, None, None, None, None), (504, "", "en", "s1", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    want = {i for i, *_ in rows if not (i < 240 and i % 6 == 0)} - {500, 501, 502, 504}
    assert set(got) == want and {"size", "source_size", "target", "taken", "text", "lang"} <= set(next(iter(got.values())).asDict())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "decontamination", "mixing"]
