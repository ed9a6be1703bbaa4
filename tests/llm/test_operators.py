"""Edge cases and brute-force comparisons of the operators, on small fixtures."""

import base64
import hashlib
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronofold.llm import bpe_table, chat_format, ivfpq, language_mixture, media, parity_join, quality, source_mixing, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, set_id string, features int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing column names."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, base, "en", "a", "x", 1), (2, base, "en", "a", "x", 1), (2, base, "en", "a", "x", 1), (3, base + " more", "en", None, "x", 1), (4, None, None, None, None, None),
        (5, "", "de", "b", "x", 1), (6, " \t\n", "de", "b", "x", 1), (None, base, None, "b", "x", 1), (7, "one two", "en", "b", "x", 1), (8, "ONE two", "en", "c", "x", 1),
        (9, "z" * 300_000 + " " + base, "en", "c", "x", 1), (10, "é " * 200_000, "fr", "c", "x", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_near_duplicates(odd):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in parity_join.jaccard_components(odd).collect())
    assert got[0] == (0, 56, 1)
    assert [x[2] for x in got[1:]] == [1, 1, 1, 1, 4, 5, 6, 7, 7, 1, 10]
    assert [x[1] for x in got if x[0] in (4, 5, 6, 7)] == [0, 0, 0, 1]
    assert parity_join.jaccard_components(odd.limit(0)).collect() == []


def test_near_duplicates_of_a_family(spark):
    rng = np.random.default_rng(1)
    base, texts = [f"t{i}" for i in range(120)], []
    for _ in range(150):
        words = list(base)
        for i in rng.choice(120, rng.integers(1, 6), replace=False):
            words[i] = f"n{rng.integers(1 << 30)}"
        texts.append(words)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in parity_join.jaccard_components(df).collect()} == {i: find(i) for i in range(len(sets))}


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 5, 70, 900):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n * 9 // 10], rng.integers(0, 1 << 63, n // 5).astype(np.uint64)]))
        if len(b):
            assert parity_join.hamming(parity_join.dense_sketch(a), parity_join.dense_sketch(b)) <= len(np.setxor1d(a, b))


def test_bpe_round_trip(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["a  b", " x ", "it's <|endoftext|> ok", "日本 ٣!", "՘ new", None, "tab\t x\n\n y", "a.b, c?"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe_table.encode_decode(df, path, keep_ids=True).collect():
        want = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == t.decode(want, skip_special_tokens=False)
    assert bpe_table.encode_decode(odd, path).count() == odd.count()
    assert bpe_table.encode_decode(odd.limit(0), path).collect() == []


def test_media_wrong_headers(spark):
    import struct

    good = media.encode_png(b" " * 192)
    for n in (0, 5, 14):
        body = b"IHDR" + b"\0" * n
        bad = good[:8] + struct.pack(">I", n) + body + struct.pack(">I", zlib.crc32(body)) + good[33:]
        with pytest.raises(media.MediaError):
            media.decode_png(bad)
        df = spark.createDataFrame([(1, 3, bytearray(bad)), (2, 3, bytearray(good)), (3, 3, None)], "doc_id long, n_bytes long, media binary")
        assert [r.error is None for r in media.media_features(df).orderBy("doc_id").collect()] == [False, True, False]


def test_media_of_every_kind_of_row(spark):
    """Images in which no row is a left difference, bytes that aren't UTF-8, a text above one block of rows, and headers without pixels."""
    texts = [b" ~" * 96, (b"\x01" + b"\0" * 5) * 32, b"\xff\xfe a\x80", bytes(range(1, 128)) * 9000, b""]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(texts)], "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
    got = {r.doc_id: r for r in media.media_features(media.to_media(df)).collect()}
    for i, x in enumerate(texts):
        padded = x.ljust(max(1, -(-len(x) // 192)) * 192, b" ")
        assert got[i].error is None and (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(x), len(padded), hashlib.sha256(padded).hexdigest())
    for width, height in ((0, 1), (64, 0)):
        head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
        with pytest.raises(media.MediaError):
            media.decode_png(b"".join([media.SIGNATURE, media._chunk(b"IHDR", head), media._chunk(b"IDAT", zlib.compress(b"\0" * height)), media._chunk(b"IEND", b"")]))


def test_media_of_more_rows_than_a_slice(spark):
    texts = [None if i % 7 == 0 else "x" * (i % 300) for i in range(2300)]
    got = {r.doc_id: r for r in media.media_features(media.to_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))).collect()}
    for i, t in enumerate(texts):
        want = (t or "").encode().ljust(192 * max(1, -(-len(t or "") // 192)), b" ")
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(t or ""), len(want), hashlib.sha256(want).hexdigest())


def test_media_round_trip(spark, odd):
    got = media.media_features(media.to_media(odd)).collect()
    assert len(got) == odd.count() and all(r.error is None for r in got)
    for r, t in ((next(x for x in got if x.doc_id == 7), b"one two"), (next(x for x in got if x.doc_id == 4), b"")):
        want = t.ljust(192, b" ")
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(t), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
    assert media.media_features(media.to_media(odd.limit(0))).collect() == []


def test_png_filters_and_damage():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (9, 12)).astype(np.uint8)
    raw = np.concatenate([np.array([[0], [1], [2], [3], [4], [4], [3], [2], [2]], np.uint8), rows], 1)
    want, before = [], np.zeros(12, int)
    for kind, line in zip(raw[:, 0], rows.astype(int), strict=True):
        cur = np.zeros(12, int)
        for x in range(12):
            a, b, c = (cur[x - 3] if x > 2 else 0), before[x], (before[x - 3] if x > 2 else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            cur[x] = (line[x] + [0, a, b, (a + b) // 2, near][kind]) % 256
        want.append(cur)
        before = cur
    assert (media.unfilter_rows(raw, 3) == np.array(want)).all()
    png = bytearray(media.encode_png(bytes(range(192)) * 3))
    assert media.decode_png(bytes(png))[3] == bytes(range(192)) * 3
    png[60] ^= 1
    with pytest.raises(media.MediaError):
        media.decode_png(bytes(png))


def test_warc_round_trip(spark):
    big = "<p>WARC/1.1\r\n\r\n" + "x" * 40_000
    rows = [(3, "u", big), (1, "u", big), (2, None, None), (5, "u", ""), (None, "u", big), (7, "u", "é")]
    got = {r.page_id: r for r in warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 6 and all(r.error is None for r in got.values())
    for page, _, html in rows:
        raw = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert {p: (r.record_type, r.refers_to) for p, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None), 5: ("revisit", 2), 7: ("response", None)}


def test_warc_missing_segment(spark, tmp_path):
    parts = warc.page_records(1, "r", "u", b"y" * 50_000)
    (tmp_path / "a.warc").write_bytes(b"".join(p + b"\r\n\r\n" for p in parts[:1] + parts[2:]))
    (row,) = warc.reassemble(warc.read_records(spark, str(tmp_path))).collect()
    assert row.error and row.payload is None


def test_chat_round_trip(spark):
    texts = ["<|im_end|>\n<|im_start|>x", "<\\|", None, "", "é<|", "</s>[INST] ok [/INST]"]
    rows = [(1, i, "assistant" if i % 2 else "user\n\\", t, 0) for i, t in enumerate(texts)] + [(None, 0, None, "n", 0), (2, None, "assistant", "late", 0), (2, 1, "assistant", "first", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss int")
    got = {r.conv_id: r for r in chat_format.chat_digests(chat_format.format_chats(df)).collect()}
    want = "".join(f"{'assistant' if i % 2 else 'user' + chr(10) + chr(92)}\n{t or ''}\n" for i, t in enumerate(texts))
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(t or "" for t in texts[1::2]).encode()).hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(b"firstlate").hexdigest() and got[None].n_turns == 1
    assert chat_format.format_chats(df.limit(0)).collect() == []


def test_mixing(spark, odd):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 40)), f"s{i % 5 if i % 3 else 0}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mixing.mix_sources(df).collect()
    again = source_mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(got) == sorted(again) and len(got) == 3000
    assert all(r.taken <= 3 * r["size"] and r.taken % r["size"] == 0 for r in got)
    size = {s: sum(r["size"] for r in got if r.source == s) for s in {r.source for r in got}}
    left, target = dict.fromkeys(size), {}
    while left:  # share by weight until none is above its cap
        rest, weights = sum(size.values()) - sum(target.values()), {s: int(s[1]) % 3 + 1 for s in left}
        level = {s: rest * w / sum(weights.values()) for s, w in weights.items()}
        full = [s for s in left if level[s] > 3 * size[s]]
        target |= {s: 3.0 * size[s] for s in full} if full else level
        left = {s: None for s in left if s not in target}
    for s in size:
        assert abs(next(r.target for r in got if r.source == s) - target[s]) < 1e-6
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) < 40
    assert source_mixing.mix_sources(odd).count() == odd.count()
    assert source_mixing.mix_sources(odd.limit(0)).collect() == []


def test_learned_operators_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 1), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for out in (toxicity.score_toxicity(odd, labels), quality.score_quality(odd, labels), language_mixture.identify(odd)):
        rows = out.collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    found = {r.doc_id: r.lang_pred for r in language_mixture.identify(odd).collect()}
    assert found[4] == found[5] == found[6] == "und"
    for out in (toxicity.score_toxicity(odd.limit(0), labels), quality.score_quality(odd.limit(0), labels), language_mixture.identify(odd.limit(0))):
        assert out.collect() == []


def test_search_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 1.0]), (None, [1.0, 0.0]), (1, [2.0, 0.0]), (8, [3.0, 0.0]), (9, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ivfpq.search(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 1), (2, 1), (3, 8), (4, 7), (5, 2)]  # rows with one id are rows each
    assert ivfpq.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_search_recall_on_unstructured_vectors(spark):
    x = np.random.default_rng(6).normal(size=(8000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ivfpq.search(df, F.col("vec_id") % 50 == 0, train_rows=4000).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    hits = 0
    for q in range(0, 8000, 50):
        s = unit @ unit[q]
        s[q] = -2
        hits += len(set(np.argsort(-s, kind="stable")[:5].tolist()) & set(got[q]))
        assert all(abs(s[v] - score) < 1e-9 for v, score in got[q].items())
    assert hits >= 0.9 * 5 * 160


def test_search_recall_where_codes_are_coarse(spark):
    """Wide vectors, sixteen entries to a code, and copies: codes alone don't tell the nearest from the next hundreds."""
    rng = np.random.default_rng(16)
    x = np.concatenate([rng.normal(size=(7600, 256)), np.repeat(rng.normal(size=(2, 256)), 200, 0)])[rng.permutation(8000)].astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ivfpq.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 8000, 50):
        s = np.round(unit @ unit[q], 12)
        s[q] = -2
        hits += len(set(np.argsort(-s, kind="stable")[:5].tolist()) & set(got[q]))
    assert hits >= 0.9 * 5 * 160


def test_word_count_is_the_pattern(spark):
    df = spark.createDataFrame([("a b c\x0bd",), (None,), (" ",)], "text string")
    assert [r[0] for r in df.select(source_mixing.words_in(F.col("text"))).collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in ("a b c\x0bd", None, " ")]


def test_toxicity_learns_from_every_fold(spark):
    """Words that occur in texts of one fold of the ids only are learned, whichever of the four it is."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    rows = [(i, f"the cat number n{i % 50} sat here" + f" vile{fold(i)} slur{fold(i)}" * (i % 2), i % 2) for i in range(1500)]
    rows += [(10_000 + f, f"the cat number n3 sat here vile{f} slur{f}", None) for f in range(1, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df, df).collect()}
    assert all(got[10_000 + f] > 0.9 for f in range(1, 5)), got


def test_texts_of_more_than_three_languages():
    rng = np.random.default_rng(8)
    like = np.full((100, 6), -30.0)
    for j in range(5):
        like[20 * j : 20 * j + 20, j] = -5.0
    share, number = language_mixture.select_languages(like, np.array([0, 80, 100]))
    assert number.tolist() == [4, 1]
    np.testing.assert_allclose(share[0], [0.25] * 4 + [0, 0], atol=1e-6)
    # against every size of set tried for every text
    offsets = np.r_[0, np.cumsum(rng.integers(1, 40, 200))]
    like = -rng.gamma(2.0, 8.0, (offsets[-1], 5))
    got, sizes = language_mixture.select_languages(like, offsets)
    n = np.diff(offsets)
    rank = np.argsort(-language_mixture.mixtures(like, offsets, np.ones((200, 5), bool))[0], 1, kind="stable")
    tried = []
    for k in range(1, 6):
        active = np.zeros((200, 5), bool)
        np.put_along_axis(active, rank[:, :k], True, 1)
        shares, total = language_mixture.mixtures(like, offsets, active)
        tried.append((total - (k - 1) * (0.5 * np.log(n) + np.log(5)), shares))
    want = np.argmax([x for x, _ in tried], 0)
    assert sizes.tolist() == (want + 1).tolist() and sizes.max() > 3
    np.testing.assert_allclose(got, np.stack([x for _, x in tried])[want, np.arange(200)], atol=1e-9)
