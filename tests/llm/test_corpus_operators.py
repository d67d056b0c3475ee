"""Deduplication, mixing, classifiers and the pipeline against plain versions."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from memloom.llm import exact_dedup, mixing, near_dedup, quality, queries, shared, toxicity
from memloom.llm.components import components
from memloom.llm.linear import Sample, indexed, lookup, merged

from oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """(doc_id, text, source) with columns that operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(c) for c in ("digest", "id", "n", "size", "key", "copies", "finish", "node", "family", "score", "keep")})


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    if name in queries.oracle_sql():
        assert_same(df, connect(SF), queries.oracle_sql()[name])
    else:
        assert df.count() > 0


# --- exact


def brute_exact(rows):
    groups = defaultdict(list)
    for k, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(k)
    return {(k, tuple(sorted(x for x in groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")] if x is not None))) for k, t, _ in rows}, groups


ROWS = [(5, "a  b", "s"), (3, "a\tb", "s"), (9, "a b", "s"), (1, None, "s"), (2, "", None), (4, "z" * 200_000, "s"), (6, "A b", "s"), (7, " ", "s"), (8, "c", "s"), (8, "c", "s"), (None, "c", "s"), (None, "d", "s")]


def check_exact(got, rows):
    _, groups = brute_exact(rows)
    assert len(got) == len(rows)
    for r in got:
        body = next(b for b, ks in groups.items() if hashlib.sha256(b.encode()).hexdigest() == r.text_sha256)
        known = [k for k in groups[body] if k is not None]
        assert (r.keep_id, r.group_size) == (min(known) if known else None, len(groups[body]))
        assert r.kept == (r.doc_id == r.keep_id)


def test_exact_groups(spark):
    check_exact(exact_dedup.exact_groups(docs(spark, ROWS)).collect(), ROWS)
    check_exact(exact_dedup.exact_groups(docs(spark, ROWS).repartition(6), max_files_per_trigger=1).collect(), ROWS)
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0
    kept = exact_dedup.dedup(docs(spark, ROWS)).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 3, 4, 6, 7, 8, None], key=str)
    assert {len(r) for r in kept} == {14} and exact_dedup.dedup(docs(spark, [])).count() == 0


def test_state_goes_on_from_call_to_call(spark, tmp_path):
    calls = [[(5, "a b", "s"), (6, "c", "s"), (7, "only here", "s")], [(3, "a  b", "s"), (8, "c", "s"), (9, "new", "s"), (9, "new", "s")], [(1, "new", "s"), (10, "a b", "s")]]
    for digest in (exact_dedup.digest_of, lambda t: F.lit("x"), lambda t: F.substring(t, 1, 0)):
        home, seen = f"{tmp_path}/{digest.__name__}{id(digest)}", []
        for rows in calls:
            seen += rows
            got = exact_dedup.exact_groups(docs(spark, rows), digest=digest, state_dir=home).collect()
            groups = brute_exact(seen)[1]
            want = [(k, min(groups[re.sub(r"\s+", " ", t)]), len(groups[re.sub(r"\s+", " ", t)])) for k, t, _ in rows]
            assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == sorted(want)
    assert {r.doc_id for r in exact_dedup.dedup(docs(spark, [(11, "c", "s"), (12, "fresh", "s")]), state_dir=f"{tmp_path}/second").collect()} == {11, 12}
    assert {r.doc_id for r in exact_dedup.dedup(docs(spark, [(13, "c", "s"), (14, "newer", "s")]), state_dir=f"{tmp_path}/second").collect()} == {14}


def test_stages_take_clashing_columns(spark):
    names = ["__gone", "__gone_id", "__gone_digest", "__digest", "__id", "__n", "__copies", "__id2", "__row", "__other", "__source", "__size", "__COPIES_"]
    df = spark.createDataFrame([(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (None, None, None)], "doc_id long, text string, source string").withColumns({n: F.lit(n) for n in names})
    for stage in (exact_dedup.dedup, near_dedup.dedup, mixing.mixed):
        out = stage(df)
        assert out.columns == df.columns and all([r[n] for n in names] == names for r in out.collect())


def test_digests_that_clash_are_told_apart_by_bytes(spark):
    rows = [(k, t, "s") for k, t in enumerate(["a", "b", "a", "b", "c", "ab", "ba"])]
    got = exact_dedup.exact_groups(docs(spark, rows), digest=lambda t: F.lit("x")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(0, 0, 2), (1, 1, 2), (2, 0, 2), (3, 1, 2), (4, 4, 1), (5, 5, 1), (6, 6, 1)}


# --- near


def sets_of(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_near(rows, width):
    ids = [k for k, *_ in rows]
    sets = {k: sets_of(t, width) for k, t, _ in rows}
    part = {k: k for k in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and part[a] != part[b]:
                lo, hi = sorted((part[a], part[b]))
                part = {k: lo if p == hi else p for k, p in part.items()}
    return {(k, len(sets[k]), part[k]) for k in ids}


def family(r, base, count, most):
    """Copies of a text with some words changed: close ones, borderline ones and far ones."""
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [512, 4])
def test_near_groups(spark, monkeypatch, block):
    # functions reach the workers by reference, so blocks are set through the plan on the driver
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", block)
    r = random.Random(3)
    texts = []
    for size, most in ((60, 8), (40, 14), (200, 25), (8, 1)):
        base = [f"w{r.randrange(10**6)}" for _ in range(size)]
        texts += family(r, base, 14, most)
    texts += [None, "", "  ", "one", "ONE", "two words", "Two Words", "x " * 3000, "x y " * 3000]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    r.shuffle(rows)
    for width in (2, 5):
        got = {(x.doc_id, x.n_shingles, x.component_id) for x in near_dedup.near_groups(docs(spark, rows), width).collect()}
        assert got == brute_near(rows, width)


def test_near_dedup_keeps_one_of_each_group(spark):
    rows = [(4, "a b c d e f", "s"), (2, "A b c d e f", "s"), (2, "A b c d e f", "s"), (7, None, "s"), (None, "a b c d e f", "s"), (None, "q", "s"), (8, "other words are here now", "s")]
    kept = near_dedup.dedup(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == [(2, "A b c d e f"), (2, "A b c d e f"), (7, None), (8, "other words are here now")] or sorted(r.doc_id for r in kept if r.doc_id is not None) == [2, 2, 7, 8]
    assert any(r.doc_id is None and r.text == "q" for r in kept)
    assert near_dedup.dedup(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        near_dedup.near_groups(docs(spark, rows), percent=50)


def test_repeated_ids_and_structured_words(spark):
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows = [(1, a, 0), (1, b, 0), (2, a + ["z"], 0), (3, b + ["z"], 0), (4, b + ["y"], 0), (9, ["q"], 0)]
    got = near_dedup.near_groups(docs(spark, [(k, " ".join(w), "s") for k, w, _ in rows])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (9, 9)}
    x, y = "a", "b"
    while len(x) < 1024:
        x, y = x + y, y + x
    assert all(r.kept for r in near_dedup.near_groups(docs(spark, [(1, x, "s"), (2, y, "s")])).collect())


@pytest.mark.parametrize("sketches, nodes", [(3, 512), (2, 2)])
def test_hot_buckets_and_families(spark, monkeypatch, sketches, nodes):
    monkeypatch.setattr(near_dedup, "BLOCK_SKETCHES", sketches)
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", nodes)
    r = random.Random(8)
    base = [f"w{k}" for k in range(80)]
    half = base[:50] + [f"v{k}" for k in range(30)]
    texts = family(r, base, 25, 9) + family(r, half, 25, 9)
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in near_dedup.near_groups(docs(spark, rows), 2).collect()}
    assert got == brute_near(rows, 2)


def test_sketches_estimate_differences():
    r = np.random.default_rng(1)
    for shared_part in (0.95, 0.8, 0.3):
        n = 2000
        both = r.integers(0, 1 << 63, int(n * shared_part), np.uint64)
        a, b = (np.unique(np.r_[both, r.integers(0, 1 << 63, (n - len(both)) // 2, np.uint64)]) for _ in range(2))
        m = np.array([near_dedup.samples(a), near_dedup.samples(b)])
        odd = near_dedup.odd_sketches(m).view(np.uint64)
        far = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
        differ = int((m[0] != m[1]).sum())
        assert abs(far - 512 * (1 - np.exp(-4 * differ / 1024))) < 35 and far <= 2 * differ
        assert (far <= near_dedup.SKETCH_LIMIT) == (shared_part >= 0.8)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(40)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    part = {}
    for a, b in edges:
        if a is not None and a != b:
            part.setdefault(a, a), part.setdefault(b, b)
            lo, hi = sorted((part[a], part[b]))
            part = {k: lo if p == hi else p for k, p in part.items()}
    assert got == part
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mixing(spark):
    r = random.Random(5)
    rows = [(k, "w " * r.randrange(0, 40), r.choice(["b", "b", "b", "b", "a", "c", None, "é"])) for k in range(600)] + [(700, None, "a"), (701, "long " * 900, "c"), (702, "same", "a"), (702, "same", "a"), (None, "x y", "b")]
    got = mixing.mix(docs(spark, rows)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for x in got:
        sizes[x.source] += x.size
        taken[x.source] += x.size * x.copies
        assert 0 <= x.copies <= 3
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source]
    # what the longest document leaves of its source's share goes to the others
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 900 + 40
    assert sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.mixed(docs(spark, rows))
    assert out.columns == docs(spark, []).columns
    assert out.count() == sum(x.copies for x in got)
    assert mixing.mix(docs(spark, [])).count() == 0 == mixing.mixed(docs(spark, [])).count()
    assert mixing.mix(docs(spark, [(1, None, None), (2, "", "a")])).count() == 2


# --- classifiers


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for fit, label, by, held in ((quality.quality_scores, "quality", 3, 1), (toxicity.toxicity_scores, "toxic", 5, 0)):
        rest = F.crc32(F.col("doc_id").cast("string")) % by
        got = fit(d, lab, rest != held).join(lab, "doc_id").where(rest == held).select(label, "predicted").collect()
        right = np.mean([r[0] == r[1] for r in got])
        assert right >= 0.9, (label, right)


def test_classifiers_take_any_rows(spark):
    texts = [(k, t, "s") for k, t in enumerate(["good words here", "bad!! BAD!! bad!!", None, "", "x " * 20_000, "good words here"])] + [(0, "good words here", "s"), (None, "bad!! BAD!!", "s")]
    lab = labels(spark, [(0, 1, 0), (1, 0, 1), (1, 0, 1), (2, None, None), (None, 1, 1), (99, 1, 1)])
    for fit in (quality.quality_scores, toxicity.toxicity_scores):
        got = fit(docs(spark, texts), lab, F.lit(True)).collect()
        assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert {r.score for r in fit(docs(spark, texts), lab.limit(0), F.lit(True)).collect()} == {0.5}
        assert {r.predicted for r in fit(docs(spark, texts), lab.where("doc_id = 99"), F.lit(True)).collect()} == {1}
        assert fit(docs(spark, []), lab, F.lit(True)).count() == 0
    assert toxicity.without_toxic(docs(spark, texts), lab.limit(0)).count() == len(texts)
    assert toxicity.without_toxic(docs(spark, []), lab).count() == 0


def test_dual_coordinate_descent_parts_the_classes():
    r = np.random.default_rng(0)
    x = r.standard_normal((200, 5))
    sign = np.sign(x @ np.array([1.0, -2, 0.5, 0, 1]))
    at, column = np.arange(0, 1001, 5), np.tile(np.arange(5), 200)
    w = quality.dual_coordinate_descent(at, column, x.ravel(), sign, np.full(200, 10.0), 5, rounds=60)
    assert (np.sign(x @ w) == sign).mean() > 0.97


def sample_of(rows):
    row, key = toxicity.of_texts([t for _, t in rows])
    at = np.r_[0, np.cumsum(np.bincount(row, minlength=len(rows)))]
    text, change, keys, sign = toxicity.swaps(pa.array([t for _, t in rows]))
    return Sample(np.array([y for y, _ in rows]), at, key, merged(text * 10**6 + change, keys, sign))


def biased_rows(n=400):
    """One group is named far more often in toxic texts."""
    r = random.Random(1)
    rows = []
    for k in range(n):
        toxic = k % 2
        group = "muslim" if r.random() < (0.85 if toxic else 0.15) else "christian"
        rows.append((toxic, f"{'awful stuff' if toxic and r.random() < 0.6 else 'nice day'} said the {group} today. Nothing else happened"))
    return rows


def test_swapped_sentences():
    got = toxicity.swapped("Some Women spoke. WOMEN and men, humane! none here")
    assert got == [("some women spoke", "some men spoke"), ("some women spoke", "some girls spoke"), (" women and men, humane", " women and girls, humane"), (" women and men, humane", " women and boys, humane"), (" women and men, humane", " men and men, humane"), (" women and men, humane", " girls and men, humane")]

    def brute(a, b):
        def found(s):
            return {k for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", s) for k in toxicity.word_keys(w)}

        return {(k, 1) for k in found(b) - found(a)} | {(k, -1) for k in found(a) - found(b)}

    pair, key, sign = toxicity.changes_of(got)
    for k, (a, b) in enumerate(got):
        assert {(int(x), int(s)) for p, x, s in zip(pair, key, sign) if p == k} == brute(a, b)


def test_counterfactual_gradient():
    sample = sample_of(biased_rows(40))
    names, at, column = indexed(sample, 1)
    row = np.repeat(np.arange(len(sample.y)), np.diff(at))
    p = toxicity.problem(sample, names, row, column, np.arange(len(sample.y)) % 5 != 0, 3.0)
    r = np.random.default_rng(0)
    w, b = r.standard_normal(len(names)), 0.3
    g, gb = p.gradient(w, b)
    for j in range(len(names)):
        e = np.zeros(len(names))
        e[j] = 1e-6
        assert (p.loss(w + e, b) - p.loss(w - e, b)) / 2e-6 == pytest.approx(g[j], abs=1e-5)
    assert (p.loss(w, b + 1e-6) - p.loss(w, b - 1e-6)) / 2e-6 == pytest.approx(gb, abs=1e-5)
    # the loss by its definition: the real scores of the real sentences
    at = {int(k): x for k, x in zip(names, w)}
    score = lambda s: sum(at.get(k, 0.0) for k in toxicity.of_texts([s])[1].tolist())
    pairs = toxicity.neutral() + [x for _, t in biased_rows(40) for x in toxicity.swapped(t)]
    penalty = 3.0 / len(sample.y) * sum((score(x) - score(z)) ** 2 for x, z in pairs)
    plain = toxicity.problem(sample, names, row, column, np.arange(len(sample.y)) % 5 != 0, 0.0)
    assert p.loss(w, b) - plain.loss(w, b) == pytest.approx(penalty, rel=1e-9)


def test_every_weight_is_settled():
    sample = sample_of(biased_rows())
    names, at, column = indexed(sample, 4)
    row = np.repeat(np.arange(len(sample.y)), np.diff(at))
    model = toxicity.fit(sample, rounds=800)
    w = np.zeros(len(names))
    w[np.searchsorted(names, model.names)] = model.weight
    p = toxicity.problem(sample, names, row, column, np.ones(len(sample.y), bool), 1.0)
    g, _ = p.gradient(w, model.bias)
    assert (np.abs(g[w == 0]) <= 1.02 * 4e-4).all() and np.abs(g[w != 0] + 4e-4 * np.sign(w[w != 0])).max(initial=0) < 2e-4


def test_fewer_neutral_mentions_are_called_toxic():
    sample, neutral = sample_of(biased_rows()), [f"nice day said the muslim {x}" for x in ("today", "and left", "at home", "who came today")]

    def called(counterfactual):
        model = toxicity.fit(sample, counterfactual=counterfactual)
        row, key = toxicity.of_texts(neutral + ["awful stuff said the christian today"])
        score = model(*lookup(model.names, row, key), len(neutral) + 1)
        return (score[:-1] >= 0.5).sum(), score[-1]

    (free, _), (tied, toxic) = called(0.0), called(20.0)
    assert free >= 3 and tied == 0 and toxic >= 0.5


# --- the pipeline


def brute_pipeline(spark, rows, labels_df):
    """The stages in plain Python, but for the classifier, whose scores are taken as they are."""
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), labels_df, F.lit(True)).collect()}
    rows = [r for r in rows if scores[r[0]] < 0.5]
    seen = {}
    for r in sorted(rows):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    rows = list(seen.values())
    part = {k: p for k, _, p in brute_near([(r[0], r[1], "") for r in rows], 5)}
    return {r[0] for r in rows if part[r[0]] == r[0]}


def test_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in d.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    columns = d.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        d = shared.durable(stage(spark, d, SF), name)
        assert d.columns == columns
    assert {r.doc_id for r in d.collect()} == brute_pipeline(spark, rows, spark.read.parquet(f"{SF}/labels.parquet"))
    mixed = shared.durable(corpus_pipeline.STAGES[3][1](spark, d, SF), "mixing")
    assert mixed.columns == columns
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, SF)
    got = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in got) <= 2048 and sum(r.n for r in got) > 0.85 * 2048 * (len(got) - 4)
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
