"""The learned operators against plain Python on small tables, and on held-out rows."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import language_mixture, quality, toxicity

SF = "/root/testdata/sf0.01"


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def plain_kneser_ney(texts, kinds):
    """Log-ratio of every word: counts once a text, discounts from counts of counts, interpolated with continuation counts and shared ones."""
    pairs_of = lambda t: list(dict.fromkeys(zip(["", *t.split()], t.split(), strict=False)))
    n = [Counter(), Counter()]
    for t, k in zip(texts, kinds, strict=True):
        if k is not None:
            n[k].update(pairs_of(t))
    d = []
    for c in n:
        one, two = (sum(v == i for v in c.values()) for i in (1, 2))
        d.append(min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5)
    every = set(n[0]) | set(n[1])
    before = [Counter(w for _, w in c) for c in (*n, every)]

    def p(k, u, w):
        shared = (before[2][w] + 0.5) / (len(every) + 0.5 * (len(before[2]) + 1))
        lower = max(before[k][w] - d[k], 0) / len(n[k]) + d[k] * len(before[k]) / len(n[k]) * shared
        total, kinds_after = sum(v for (a, _), v in n[k].items() if a == u), sum(a == u for a, _ in n[k])
        return lower if not total else max(n[k][u, w] - d[k], 0) / total + d[k] * kinds_after / total * lower

    return [np.mean([math.log(p(1, u, w)) - math.log(p(0, u, w)) for u, w in zip(["", *t.split()], t.split(), strict=False)]) if t.split() else 0.0 for t in texts]


def small_texts():
    rng = np.random.default_rng(11)
    return [" ".join(f"w{x}" for x in rng.integers(0, 12 + 6 * (i % 2), rng.integers(1, 30))) for i in range(60)]


def test_toxicity_is_kneser_ney(spark):
    texts = [*small_texts(), "", "never seen words", "w1"]
    kinds = [None if fold(i) == 0 or i % 7 == 0 or not t else i % 2 for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(kinds) if k is not None], "doc_id long, toxic int")
    got = {r.doc_id: r.ratio for r in toxicity.score_toxicity(docs, labels).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(texts))], plain_kneser_ney(texts, kinds), atol=1e-9)


def test_toxicity_without_own_counts(spark):
    """A sampled text's features without its own counts are those of a model that never saw it, but for the discounts."""
    texts = small_texts()[:12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def features(ids):
        marks = spark.createDataFrame([(i, i % 2, True) for i in ids], "doc_id long, kind int, sampled boolean")
        found, discount = toxicity.text_features(docs, marks)
        return {r.doc_id: r for r in found.collect()}, discount

    keep = toxicity.discounts
    toxicity.discounts = lambda seen: np.array([0.7, 0.8])
    try:
        whole, _ = features(range(12))
        for i in (2, 5):
            np.testing.assert_allclose(whole[i].own, features([j for j in range(12) if j != i])[0][i].found, atol=1e-12)
    finally:
        toxicity.discounts = keep


def test_toxicity_held_out(tables):
    docs, labels = tables
    rows = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    accurate, area = toxicity.accuracy(rows.toxic.to_numpy(), rows.score.to_numpy())
    assert len(rows) > 50 and accurate > 0.9 and area > 0.85


def test_messages_come_back_in_order():
    rng = np.random.default_rng(12)
    for bits in (20, 43, 62):
        keys = rng.integers(0, 1 << bits, 500).astype(np.uint64)
        keys[100:120] = keys[:20]
        values = rng.integers(0, 9, (2, 500))
        sent = toxicity.messages(4, keys, values, bits, 7)
        other = toxicity.messages(9, keys[:50], values[:, :50], bits, 7)
        import pyarrow as pa

        both = pa.concat_tables([other, sent])
        replies = pa.concat_tables([toxicity.answers(None, both.filter(pa.compute.equal(both.column("bucket"), b))) for b in sorted(set(both.column("bucket").to_pylist()))])
        got = toxicity.gathered(replies.filter(pa.compute.equal(replies.column("chunk"), 4)), keys)
        want = defaultdict(lambda: np.zeros(2, int))
        for part in (range(500), range(50)):
            for i in part:
                want[int(keys[i])] += values[:, i]
        assert (got[:2].T == np.array([want[int(k)] for k in keys])).all()
        owned = [int(k) for k, o in zip(keys, got[2], strict=True) if o]
        assert sorted(owned) == sorted(k for k in want if want[k].any())


def test_numbers_are_of_training_words():
    """Words get one number each, all words without a use the same one, whichever chunk asks."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    words = np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64))
    sent = []
    for chunk in range(3):
        mine = np.sort(rng.choice(words, 200, replace=False))
        uses = rng.integers(0, 3, 200) * (mine % np.uint64(3) > 0)
        sent.append((mine, uses, toxicity.messages(chunk, mine, uses[None], 64, 4)))
    total = Counter()
    for mine, uses, _ in sent:
        total.update(dict(zip(mine.tolist(), uses.tolist(), strict=True)))
    every = pa.concat_tables([m for *_, m in sent])
    replies = pa.concat_tables([toxicity.ranks((pa.scalar(b),), every.filter(pa.compute.equal(every.column("bucket"), b))) for b in range(4)])
    number = {}
    for chunk, (mine, _, _) in enumerate(sent):
        got = toxicity.numbers(replies.filter(pa.compute.equal(replies.column("chunk"), chunk)), 4)
        for w, x in zip(mine.tolist(), got.tolist(), strict=True):
            assert number.setdefault(w, x) == x and (x == 1) == (total[w] == 0)
    seen = [x for x in number.values() if x != 1]
    assert len(set(seen)) == len(seen) and min(seen) >= 2


def test_mixture_is_plain_em():
    rng = np.random.default_rng(13)
    offsets = np.r_[0, np.cumsum(rng.integers(1, 20, 30))]
    like = -rng.gamma(2.0, 4.0, (offsets[-1], 3))
    share, total = language_mixture.mixtures(like, offsets, np.ones((30, 3), bool))
    for i in range(30):
        words, s = like[offsets[i] : offsets[i + 1]], np.full(3, 1 / 3)
        for _ in range(language_mixture.ROUNDS):
            new = np.mean([np.exp(w) * s / (np.exp(w) * s).sum() for w in words], 0)
            stop = np.abs(new - s).max() <= language_mixture.TOLERANCE
            s = new
            if stop:
                break
        np.testing.assert_allclose(share[i], s, atol=1e-9)
        assert abs(total[i] - sum(math.log((np.exp(w) * s).sum()) for w in words)) < 1e-6


@pytest.mark.parametrize(("langs", "missed"), [(1, 0), (2, 0), (4, 0), (6, 0), (8, 3)])
def test_language_sets_against_all_subsets(langs, missed):
    """Random likelihoods, the hardest case: a search by single steps may miss one set in a hundred of eight languages."""
    rng = np.random.default_rng(langs)
    n = rng.integers(1, 60, 300)
    offsets = np.r_[0, np.cumsum(n)]
    like, penalty = rng.normal(0, 3, (offsets[-1], langs)), 0.5 * np.log(n) + np.log(langs)
    best = np.full(300, -np.inf)
    for k in range(1, langs + 1):
        for some in itertools.combinations(range(langs), k):
            active = np.zeros((300, langs), bool)
            active[:, some] = True
            best = np.maximum(best, language_mixture.mixtures(like, offsets, active)[1] - (k - 1) * penalty)
    share, number = language_mixture.select_languages(like, offsets)
    got = np.add.reduceat(np.log((np.exp(like) * np.repeat(share, n, 0)).sum(1)), offsets[:-1]) - (number - 1) * penalty
    assert (got < best - 1e-3).sum() <= missed and ((share > 0).sum(1) <= number).all()
    np.testing.assert_allclose(share.sum(1), 1)


def test_language_counts_are_plain(spark):
    rows = [("en", "the cat"), ("en", "Été, x9!"), ("de", ""), ("de", None), (None, "lost"), ("de", "ja")]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    want = defaultdict(Counter)
    for lang, text in rows:
        if lang and text is not None:
            raw = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in "".join(c.lower() if c < "\x80" else c for c in text).encode())
            for i in range(len(raw)):
                gram = b" "[i > 0 :] + raw[max(0, i - 1) : i + 2] + b" " * (i + 1 == len(raw))
                want[lang][int(language_mixture._grams(np.frombuffer(gram, np.uint8))[1])] += 1
    got = defaultdict(Counter)
    for r in language_mixture.count_grams(df).collect():
        for j, n in enumerate(np.frombuffer(r.counts, np.int64)):
            if n:
                got[r.lang][r.slice * ((1 << language_mixture.BITS) // 16) + j] += int(n)
    assert got == want


def test_language_does_not_depend_on_neighbours(spark, tables):
    docs, _ = tables
    names, table = language_mixture.fit(docs)
    short = [(i, t) for i, t in enumerate(["la", "un", "der", "the", "no", "si", "on", "me", "a", "de la", "die", "les"])]
    near = [(100 + i, r.text[:200]) for i, r in enumerate(docs.where("text is not null").orderBy("doc_id").limit(12).collect())]
    alone = {i: language_mixture.predict(spark.createDataFrame([(i, t)], "doc_id long, text string"), names, table).first() for i, t in short}
    mixed = [x for pair in zip(near, short, strict=True) for x in pair]
    for rows in (mixed, mixed[::-1]):
        got = {r.doc_id: r for r in language_mixture.predict(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), names, table).collect()}
        assert all(got[i] == alone[i] for i, _ in short)


def test_language_held_out(tables):
    docs, _ = tables
    rows = language_mixture.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert len(rows) > 100 and (rows.lang == rows.lang_pred).mean() > 0.98


def test_quality_is_beta_binomial(spark):
    rng = np.random.default_rng(14)
    hosts = ["a", "a", "a", "b", "b", None, "c"]
    rows = [(i, " ".join("good words here".split() * int(rng.integers(1, 9))) + "!#$" * int(rng.integers(0, 30)), hosts[i % 7], f"l{i % 3}" if i % 5 else None) for i in range(150)]
    rows += [rows[3], (None, "no id", "a", "l1"), (900, None, "solo", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    marks = [(i, int("#" not in rows[i][1])) for i in range(0, 150, 2)]
    got = quality.score_quality(docs, spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    known = {i: v for i, v in marks if fold(i)}
    assert all(abs(r.evidence - known.get(r.doc_id, r.doc_score)) < 1e-12 for r in got)
    host, path = defaultdict(list), defaultdict(list)
    for r in got:
        host[r.host].append(r.evidence)
        path[r.host, r.path].append(r.evidence)
    prior = sum(r.evidence for r in got) / len(got)

    def strength(groups):
        """(numbers, sums, priors) of sites: pseudo-documents by the method of moments."""
        n, k, m = map(np.array, zip(*groups, strict=True))
        chance = (n * m * (1 - m)).sum() / n.sum()
        between = ((n * (k / n - m) ** 2).sum() - len(n) * chance) / max(n.sum() - (n * n).sum() / n.sum(), 1e-9)
        return min(1e6, max(1.0, chance / max(between, 1e-9) - 1))

    a = strength([(len(v), sum(v), prior) for v in host.values()])
    b = strength([(len(v), sum(v), (sum(host[h]) + a * prior) / (len(host[h]) + a)) for (h, _), v in path.items()])
    for r in got:
        h, p = host[r.host], path[r.host, r.path]
        of_host = (sum(h) - r.evidence + a * prior) / (len(h) - 1 + a)
        of_path = (sum(p) - r.evidence + b * of_host) / (len(p) - 1 + b)
        z = math.log(r.doc_score / (1 - r.doc_score)) + math.log(of_path / (1 - of_path)) - math.log(prior / (1 - prior))
        np.testing.assert_allclose([r.host_posterior, r.path_posterior, r.score], [of_host, of_path, 1 / (1 + math.exp(-z))], rtol=1e-6)


def test_quality_held_out(tables):
    docs, labels = tables
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(rows) > 50 and (rows.predicted == rows.quality).mean() > 0.95


@pytest.mark.parametrize("seed", [0, 1, 2])
@pytest.mark.parametrize("name", ["toxicity", "language", "quality"])
def test_order_and_partitions_do_not_matter(tables, name, seed):
    docs, labels = tables
    some = docs.where(f"doc_id % 3 = {seed}").limit(200).cache()
    f = {"toxicity": lambda d: toxicity.score_toxicity(d, labels).select("doc_id", F.round("score", 9)), "language": lambda d: language_mixture.identify(d).select("doc_id", "lang_pred", "score"), "quality": lambda d: quality.score_quality(d, labels).select("doc_id", F.round("score", 9))}[name]
    assert sorted(f(some.coalesce(1)).collect()) == sorted(f(some.orderBy(F.xxhash64("doc_id", F.lit(seed))).repartition(5 + seed)).collect())


def test_pairs_stay_apart():
    """Pairs are numbers of words, mapped one to one: no two of them meet."""
    got = toxicity.Pairs(np.arange(2, 12), np.array([0, 1, 0, 1, 2, 9]), np.array([4, 0, 2]), 4)
    assert got.times.tolist().count(2) == 1 and len(got.keys) == len(set(got.keys.tolist())) == 5
    for bits in (4, 7, 40, 64):
        x = np.unique(np.random.default_rng(bits).integers(0, 1 << min(bits, 62), 3000).astype(np.uint64))
        y = toxicity.scramble(x, bits)
        assert len(np.unique(y)) == len(x) and (toxicity.unscramble(y, bits) == x).all() and int(y.max()) < 1 << bits


def test_packed_counts_come_back():
    rng = np.random.default_rng(5)
    for rows in (2, 3, 7, 8):
        bits = toxicity._bits_of(rows)
        for n in (0, 1, 500):
            values = np.stack([rng.integers(0, 2, n) if b == 1 else rng.choice([0, 1, 2, (1 << b) - 2, (1 << b) - 1, 1 << b, 70_000, 1 << 40], n) for b in bits]).astype(np.int64)
            parts = [x.tobytes() for x in toxicity.pack_counts(values, bits)]
            assert (toxicity.unpack_counts(parts, bits) == values).all()
            keys = np.sort(rng.choice(1 << 40, n, replace=False).astype(np.uint64))
            if rows != 3:
                back, same = toxicity.unpack_message(toxicity.pack_message(keys, values))
                assert (back == keys).all() and (same == values).all()
