"""Media columns, packing, language identification and language-model scoring."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sablefish.llm import langid, lattice, media, packing

from .conftest import DE, EN, corpus, words


def test_wav_round_trip():
    for text in (None, "", "a", "x" * 64, "é" * 1000):
        values = media.clip(text)
        data = (text or "").encode()
        assert values[0] == len(data) and values[1] % 64 == 0 and values[1] >= max(64, len(data))
        assert values[2] == hashlib.sha256(media.pad(data)).hexdigest()
        assert media.from_wav(media.to_wav(media.pad(data))) == media.pad(data)
    assert len(media.pad(b"")) == 64 and len(media.pad(b"x" * 64)) == 64 and len(media.pad(b"x" * 65)) == 128


def test_peaks_follow_a_tone():
    t = np.arange(16_384)
    tone = (128 + 100 * np.sin(2 * np.pi * 100 * t / media.FRAME)).astype(np.uint8)
    frame, bins, n_frames = media.band_peaks(tone)
    assert n_frames == 31 and (bins[(bins >= 48) & (bins < 128)] == 100).all() and len(frame)
    blocks, media.BLOCK_FRAMES = media.BLOCK_FRAMES, 7
    try:
        assert all(map(np.array_equal, media.landmarks(tone), media.landmarks(tone)))
        cut = media.band_peaks(tone)
    finally:
        media.BLOCK_FRAMES = blocks
    assert np.array_equal(cut[0], frame) and np.array_equal(cut[1], bins)


def test_media_over_a_table(docs, no_docs):
    rows = media.sound_fingerprints(docs).collect()
    assert len(rows) == docs.count() and media.sound_fingerprints(no_docs).count() == 0
    by_text = collections.defaultdict(set)
    texts = {(i, t) for i, t, _, _ in corpus()}
    for i, t in texts:
        for r in rows:
            if r["doc_id"] == i and r["n_bytes"] == len((t or "").encode()):
                by_text[t].add((r["payload_sha256"], r["tail_crc32"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())


@pytest.fixture(scope="module")
def reference_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def test_words_have_the_ids_of_whole_texts(reference_tokenizer):
    texts = [t or "" for _, t, _, _ in corpus()] + ["a<|endoftext|>b <|startoftext|>", "it's x́ 12ab Ü"]
    ids, ends = packing.tokenizer_at(None).encode(pa.array(texts))
    start = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[start:end].tolist() == reference_tokenizer.encode(text, add_special_tokens=False).ids
        start = end


def test_packing(spark, docs, no_docs, reference_tokenizer):
    pieces = packing.token_pieces(docs)
    rows = packing.pack(spark, pieces).collect()
    expected = collections.Counter()
    for i, t, _, _ in corpus():
        ids = [*reference_tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], dtype="<u4")
            expected[i, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert expected == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == max(1, -(-sum(r["length"] for r in rows) // 2048)) or len(bins) <= 1.2 * sum(r["length"] for r in rows) / 2048
    assert packing.pack(spark, packing.token_pieces(no_docs)).count() == 0


def brute_pack(sizes, capacity):
    """Greedy matching of large items and best fit of small ones, item by item."""
    large, small = sorted((s for s in sizes if s > capacity / 3), reverse=True), sorted((s for s in sizes if s <= capacity / 3), reverse=True)
    gaps = []
    while large:
        a = large.pop(0)
        partner = next((b for b in large if a + b <= capacity), None)
        if partner is not None:
            large.remove(partner)
        gaps.append(capacity - a - (partner or 0))
    for s in small:
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(fit)] -= s
    return len(gaps)


def test_bins_of_the_plan():
    rng = np.random.default_rng(1)
    for capacity in (9, 30, 100):
        for n in (1, 5, 60, 300):
            sizes = rng.integers(1, capacity + 1, n).tolist()
            histogram = collections.Counter(sizes)
            runs, bins = packing.plan_bins(histogram, capacity)
            used, placed, items = collections.Counter(), collections.defaultdict(list), collections.Counter()
            for length, first, count, each, first_bin, offset in runs:
                assert first == items[length]
                items[length] += count * each
                for k in range(count * each):
                    placed[first_bin + k // each].append((offset + k % each * length, length))
                    used[first_bin + k // each] += length
            assert items == histogram and len(placed) == bins and max(used.values()) <= capacity
            for parts in placed.values():
                at = 0
                for offset, length in sorted(parts):
                    assert offset == at
                    at += length
            assert bins == brute_pack(sizes, capacity)
    assert packing.plan_bins({}, 10) == ([], 0)


def columns(texts):
    n = np.array([len(t) for t in texts])
    x = np.full((n.max(), len(texts)), langid.PAD)
    for k, t in enumerate(texts):
        x[: len(t), k] = list(t)
    return x, n


def test_gradients_of_the_network():
    net = langid.Network(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, n = columns([b"abc", b"de", b"x", b"hello"])
    label = np.array([0, 1, 2, 1])
    _, grads = net.train_step(x, n, label)
    assert grads.keys() == net.p.keys()
    for k, at in {"uzf": (1, 3), "urf": (0, 2), "unb": (2, 1), "xzf": (ord("e"), 3), "xrb": (ord("l"), 2), "xnb": (ord("a"), 0), "bf": (2,), "bb": (1,), "o": (5, 1), "ob": (2,)}.items():
        old = net.p[k][at]
        net.p[k][at] = old + 1e-4
        up, _ = net.train_step(x, n, label)
        net.p[k][at] = old - 1e-4
        down, _ = net.train_step(x, n, label)
        net.p[k][at] = old
        assert abs((up - down) / 2e-4 - grads[k][at]) < 1e-4, k


@pytest.fixture(scope="module")
def trained():
    import random

    rng = random.Random(2)
    return langid.fit([(words(rng, 60, EN), "en") for _ in range(12)] + [(words(rng, 60, DE), "de") for _ in range(12)], steps=150)


def one_direction(p, d, data):
    """The states of a recurrent layer, byte by byte."""
    h, out = np.zeros(len(p["bf"])), []
    for c in data:
        z, r = (langid.sigmoid(p[f"x{g}{d}"][c] + h @ p[f"u{g}{d}"]) for g in "zr")
        n = np.tanh(p[f"xn{d}"][c] + r * (h @ p[f"un{d}"] + p[f"b{d}"]))
        h = (1 - z) * n + z * h
        out.append(h)
    return out


def distributions(net, data):
    """The distribution at every byte."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    f, b = one_direction(p, "f", data), one_direction(p, "b", data[::-1])[::-1]
    logits = np.array([np.concatenate(x) @ p["o"] + p["ob"] for x in zip(f, b, strict=True)])
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_every_position_is_labelled(trained, monkeypatch):
    net, _ = trained
    texts = ["the and whing", "keit the and", "", None, "schung  \n keit über 漢字", "x", "whing " * 40]
    for segment, context, rows in ((512, 32, 1024), (16, 4, 3), (5, 7, 2)):
        monkeypatch.setattr(langid, "SEGMENT", segment)
        monkeypatch.setattr(langid, "CONTEXT", context)
        monkeypatch.setattr(langid, "ROWS", rows)
        for text, share in zip(texts, net.shares(pa.array(texts)), strict=True):
            data, total = (text or "").encode(), np.zeros(len(net.p["ob"]))
            for k in range(0, len(data), segment):
                low = max(0, k - context)
                part = data[low : min(len(data), k + segment + context)]
                total += distributions(net, part)[k - low : k - low + segment].sum(axis=0)
            assert np.allclose(share, total / max(1, len(data)), atol=1e-5)
    # a word's labels depend on what stands beside it
    assert not np.allclose(distributions(net, b"the keit")[:3], distributions(net, b"the and ")[:3], atol=1e-6)


def test_equal_texts_in_other_company(trained):
    net, _ = trained
    texts = [t for _, t, _, _ in corpus()]
    shares = np.round(net.shares(pa.array(texts)), 6)
    assert np.array_equal(shares[::-1], np.round(net.shares(pa.array(texts[::-1])), 6))
    assert np.array_equal(shares[:1], np.round(net.shares(pa.array(texts[:1])), 6))


def test_identify(spark, docs):
    rows = langid.identify(spark, docs).collect()
    assert langid.identify(spark, docs).columns == ["doc_id", "held_out", "lang_pred", "score"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    assert collections.Counter((r["doc_id"], r["held_out"]) for r in rows) == collections.Counter((i, held(i)) for i, _, _, _ in corpus())
    lang = {i: lang for i, t, lang, _ in corpus() if t and lang and len(t) > 60 and i not in (300, 401, 402)}
    found = [(r["lang_pred"], lang[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in lang]
    assert len(found) > 5 and sum(a == b for a, b in found) >= 0.9 * len(found)
    # a label that only held-out rows have is never learned
    odd = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "xx").otherwise(F.col("lang")))
    assert langid.learn(spark, odd, steps=2)[1] == ["de", "en"]


def test_language(spark, docs, no_docs, trained):
    rows = langid.predict(docs, trained).select("doc_id", "text", "lang", "lang_pred", "score").collect()
    known = [r for r in rows if r["text"] and r["lang"] and len(r["text"]) > 60 and r["doc_id"] != 401 and any(map(str.isalpha, r["text"]))]
    assert sum(r["lang"] == r["lang_pred"] for r in known) >= 0.95 * len(known)
    for r in rows:
        silent = r["text"] is None or not any(map(str.isalpha, r["text"]))
        assert (r["lang_pred"] == "und") == silent and 0 <= r["score"] <= 1 and (not silent or r["score"] == 0)
    assert langid.fit([]) is None and langid.predict(docs, None).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(spark, no_docs).count() == 0


def test_training_sample_is_bounded_and_even(docs):
    rows = langid.sample_rows(docs, most=20)
    counts = collections.Counter(lang for _, lang in rows)
    assert set(counts) == {"en", "de"} and max(counts.values()) <= 10
    assert rows == langid.sample_rows(docs.repartition(5), most=20)


def test_long_texts_give_excerpts(spark):
    long = "\n".join(["the and whing"] * 2000)
    rows = langid.sample_rows(spark.createDataFrame([(1, long, "en"), (2, "schung keit", "de")], "doc_id long, text string, lang string"))
    assert {lang: len(t) for t, lang in rows} == {"en": langid.MAX_CHARS, "de": 11}


def test_training_sample_has_every_language_and_no_copies(spark):
    rows = [(k, "the same text again", "en") for k in range(3000)] + [(3000 + k, f"wh{k} tion", "en") for k in range(3)] + [(4000 + k, f"text of {k}", f"l{k}") for k in range(260)]
    got = langid.sample_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(set(got)) == len(got) and {lang for _, lang in got} == {"en", *(f"l{k}" for k in range(260))}
    assert sorted(t for t, lang in got if lang == "en") == ["the same text again", "wh0 tion", "wh1 tion", "wh2 tion"]


def paths(lat, s):
    """The weights of all segmentations of a string, one by one."""
    if not s:
        return [0.0]
    out = [lat.byte * len(s[0].encode()) + r for r in paths(lat, s[1:])]
    for n in range(1, len(s) + 1):
        if lat.arcs.get(s[:n]) is not None:
            out += [lat.arcs[s[:n]] + r for r in paths(lat, s[n:])]
    return out


def test_noise_is_no_language():
    import base64
    import random

    rng = random.Random(5)
    net, langs = langid.fit([(words(rng, 80, EN), "en") for _ in range(60)] + [(words(rng, 80, DE), "de") for _ in range(60)], steps=250)
    assert langs == ["de", "en"]
    good = net.shares(pa.array([words(rng, 40, parts) for parts in (EN, DE) for _ in range(20)]))
    bad = net.shares(pa.array([base64.b64encode(rng.randbytes(200)).decode() for _ in range(20)] + [rng.randbytes(100).hex() for _ in range(20)]))
    assert good[:20, 1].min() > 0.5 and good[20:, 0].min() > 0.5 and bad[:, :2].max() < 0.15
    assert langid.noise() == langid.noise() and len(langid.noise()) == langid.NOISE


def test_lattice_sums_all_segmentations():
    lat = lattice.lattice_at(None)
    for word in ("the", "x", "über", "thing,", "漢"):
        assert math.isclose(lat.log_probability(word), math.log(sum(map(math.exp, paths(lat, lattice.SPACE + word)))) + lat.end, rel_tol=1e-9)
    assert lat.log_probability("ab" * 3000) < -1000
    both = math.log(0.25 * math.exp(lat.log_probability("thing,")) + 0.125)
    assert math.isclose(lat.log_probability("thing,", math.log(0.25), math.log(0.125)), both, rel_tol=1e-9)


def test_half_of_the_weights_are_the_vocabularys_own():
    own = lattice.vocabulary_weights()
    piece = max(own, key=own.get)
    got = lattice.adapted(own, {piece: 1e9})
    assert all(math.isclose(got[k], v / 2 + (k == piece) / 2) for k, v in own.items()) and lattice.adapted(own, {}) is own


def brute_scores(rows):
    """The score of each (id, text) by the model's definition, over whole dictionaries."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    split = lambda t: [ws for l in (t or "").split("\n") if (ws := tuple(w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", l.encode().lower())))]
    words, lines, ends = collections.Counter(), collections.Counter(), 0
    for i, t in rows:
        if not held(i):
            ends += 1
            lines.update(split(t))
            words.update(w for line in split(t) for w in line)
    discount = lambda c: max(0.1, min(0.95, sum(k == 1 for k in c) / (sum(k == 1 for k in c) + 2 * sum(k == 2 for k in c))))
    d, line_d = discount(list(words.values())), discount(list(lines.values()))
    n, v = sum(words.values()) + ends, len(words) + 1
    expected: dict = {}
    own = lattice.vocabulary_weights()
    for w in words:
        lattice.lattice_at().expect(w, expected)
    model = lattice.Lattice(lattice.adapted(own, expected))
    out = collections.Counter()
    for i, t in rows:
        score = math.log10((ends - d) / n) + math.log10(0.98)
        mine = collections.Counter(split(t)) if not held(i) else {}
        for line in split(t):
            spelled = sum(math.log10((words[w] - d if words[w] else 0) / n + d * v / n * math.exp(model.log_probability(w))) + math.log10(0.98) for w in line)
            whole = 0.02 * max(0, lines[line] - mine.get(line, 0) - line_d) / sum(lines.values())
            score += spelled + (math.log10(1 + 10 ** (math.log10(whole) - spelled)) if whole and math.log10(whole) - spelled < 300 else math.log10(whole) - spelled if whole else 0)
        out[i, len(t or ""), round(score, 4)] += 1
    return out


def test_expected_pieces():
    weights = lattice.vocabulary_weights()
    lat = lattice.Lattice(weights)
    for word in ("thing", "ab" * 400):
        counts = {}
        lat.expect(word, counts)
        assert abs(sum(len(k) * v for k, v in counts.items()) - len(word) - 1) < 0.5
    low, step = {}, 1e-5
    lat.expect("thingab", low)
    piece = max(low, key=low.get)
    up, down = (lattice.Lattice(weights | {piece: weights[piece] * math.exp(x)}).log_probability("thingab") for x in (step, -step))
    assert abs((up - down) / (2 * step) - low[piece]) < 1e-4  # the gradient of the log sum


def test_many_words_side_by_side():
    import random

    rng = random.Random(4)
    some = sorted({"".join(rng.choice([*EN, *DE, "é", "漢", "🎉", "x", "7"]) for _ in range(rng.randint(1, 4))) for _ in range(600)}) + ["ab" * 900]
    lat = lattice.lattice_at()
    own = np.array([-np.inf if k % 3 else -5.0 - k % 7 for k in range(len(some))])
    one = [lat.log_probability(w, -1.5, None if o == -np.inf else o) for w, o in zip(some, own, strict=True)]
    assert np.allclose(lat.log_probabilities(some, -1.5, own), one, rtol=1e-10)
    counts, each = {}, {}
    lat.expect_all(some, counts)
    for w in some:
        lat.expect(w, each)
    assert all(math.isclose(counts.get(k, 0), v, rel_tol=1e-6, abs_tol=1e-9) for k, v in each.items()) and len(counts) <= len(each)


def test_scores(spark, docs, no_docs):
    for head in (lattice.HEAD, 5):
        rows = lattice.score_texts(spark, docs, head=head).collect()
        words_of = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
        counts = collections.Counter()
        for i, t, _, _ in corpus():
            if not held(i):
                counts.update(words_of(t))
                counts[None] += 1
        n, v = sum(counts.values()), len(counts)
        expected = collections.Counter()
        for i, t, _, _ in corpus():
            tokens = [*words_of(t), None]
            base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
            expected[i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)] += 1
        assert expected == collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
        by_id = collections.Counter((i, score) for (i, _, score), n in brute_scores([(i, t) for i, t, _, _ in corpus()]).items() for _ in range(n))
        assert by_id == collections.Counter((r["doc_id"], round(r["score"], 4)) for r in rows)
        # the vocabulary's marginals alone, word by word
        plain, ends = lattice.lattice_at(), counts[None]
        pure = lambda t: sum(plain.log_probability(w.decode()) / math.log(10) + math.log10(1 - ends / n) for w in words_of(t)) + math.log10(ends / n)
        assert collections.Counter((i, round(pure(t), 4)) for i, t, _, _ in corpus()) == collections.Counter((r["doc_id"], round(r["lattice_score"], 4)) for r in rows)
        scores = {(r["doc_id"], r["n_tokens"]): round(r["score"], 6) for r in rows}
        if head == 5:
            assert scores == first
        first = scores
    assert lattice.score_texts(spark, no_docs).count() == 0
