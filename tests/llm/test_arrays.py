"""The array parts of the operators, without Spark."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from quadrille.llm import decontaminate, langid, packing, paragraph_dedup, quality_rank, recurrent_lm, sparse_suffix, warc, wordhash
from quadrille.llm.ngram_join import Sets, parities, prefix_size, wide_differing, wide_parities

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def py_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text))


@pytest.mark.parametrize("text", [b"", b"  ", b"One", b" a\tB\x0bc\x0cd\re\n", "É é ñ".encode(), b"x" * 600_000 + b" y " + b"ab c\n" * 200_000])
def test_words_match_the_pattern(text):
    h, starts, ends = wordhash.words(text)
    want = py_words(text)
    lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text)
    assert [lower[a:b] for a, b in zip(starts[:50], ends[:50])] == want[:50] and len(h) == len(want)
    assert len(np.unique(h)) == len(set(want))


def test_word_hashes_do_not_depend_on_place():
    one = wordhash.words(b"alpha beta")[0]
    two = wordhash.words(b"   beta \n alpha")[0]
    assert one[0] == two[1] and one[1] == two[0]


def test_many_texts_equal_each():
    texts = [None, b"", b"one two", b"x" * 300_000, b" ", b"three\n", *[b"word %d" % i for i in range(50)], b"y z " * 100_000]
    got = list(wordhash.many(texts))
    assert len(got) == len(texts) and all(np.array_equal(g, wordhash.words(t)[0]) for g, t in zip(got, texts))


def test_prefixes_of_linked_sets_meet():
    rng = random.Random(2)
    sets = Sets(3, 90, (np.zeros(0, np.uint64), np.zeros(0, np.uint8)))
    for _ in range(100):
        w = [rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(20, 200))]
        v = list(w)
        v[rng.randrange(len(v))] = "changed"
        (s, p), (t, q) = (sets.prefixes(wordhash.words(" ".join(x).encode())[0]) for x in (w, v))
        both = len(np.intersect1d(s, t))
        assert len(p[0]) == prefix_size(len(s), 90)
        if 100 * both >= 90 * (len(s) + len(t) - both):
            assert all(len(np.intersect1d(a, b)) for a, b in zip(p, q))


def test_wide_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    assert wide_parities(draw(1024)) is None
    for n in (1025, 2040, 4090, 9000):
        x = draw(n)
        y = np.concatenate([x[n // 10 :], draw(n // 6)])  # the sizes' powers of two differ for some
        for other, same in ((y, True), (draw(n), False)):
            far = wide_differing(wide_parities(x), wide_parities(other))
            assert far <= len(np.setxor1d(x, other))
            assert (180 * far <= 20 * (n + len(other))) == same or same
        if n > 4000:  # 1024 slots say nothing here
            assert 180 * np.unpackbits((parities(x) ^ parities(draw(n))).view(np.uint8)).sum() <= 20 * 2 * n


def test_minimisers_against_windows():
    h = wordhash.mix(np.random.default_rng(1).integers(0, 40, 400).astype(np.uint64))
    runs = wordhash.ngrams(h, 5)
    at, _ = sparse_suffix.minimisers(h, 5, 7)
    want = {i + k for i in range(len(runs) - 6) for k in np.flatnonzero(runs[i : i + 7] == runs[i : i + 7].min())}
    assert set(at.tolist()) == want


def test_bands_reach_their_recall():
    bands, rows = paragraph_dedup.tune_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995
    rng, hits = np.random.default_rng(0), 0
    for _ in range(300):
        both = rng.integers(0, 2**63, 80).astype(np.uint64)
        one, two = (np.concatenate([both, rng.integers(0, 2**63, 10).astype(np.uint64)]) for _ in range(2))
        hits += bool((paragraph_dedup.signature(wordhash.mix(one), bands, rows) == paragraph_dedup.signature(wordhash.mix(two), bands, rows)).any())
    assert hits >= 298


def test_sections_of_a_shared_passage():
    """Two texts that share so many words have a section in common, whatever adjoins."""
    rng = np.random.default_rng(3)
    least = paragraph_dedup.least_found(24, 28)
    assert least == 51
    for _ in range(200):
        passage = rng.integers(0, 2**63, least).astype(np.uint64)
        ids = []
        for _ in range(2):
            ends = [rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64) for _ in range(2)]
            h = np.concatenate([ends[0], passage, ends[1]])
            first, size = paragraph_dedup.sections(h, 24, 28)
            assert (size == 24).all() and (first + size <= len(h)).all()
            ids.append(set(paragraph_dedup.paragraph_ids(h, first, size).tolist()))
        assert ids[0] & ids[1]


def test_best_two_fit_is_valid_and_tight():
    rng = random.Random(4)
    assert packing.best_two_fit([], 10) == ([], [])
    for _ in range(30):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(1, 300))]
        bins, offsets = packing.best_two_fit(lengths, 100)
        for b in set(bins):
            at = 0
            for o, n in sorted((offsets[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b):
                assert o == at
                at += n
            assert at <= 100
        assert max(bins) + 1 <= 1.25 * sum(lengths) / 100 + 1
    # the smallest of [6, 3] gives way to 2 + 2, which fill the bin
    bins, _ = packing.best_two_fit([6, 3, 2, 2], 10)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_block_encoding_equals_the_library():
    e = packing.Encoder.of(TOKENIZER)
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCéÉñßœ0123456789.,;!?#*%$&|<>()\n\t  '—€"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    texts += ["", " ", "It's we'll", "İstanbul", "<|endoftext|> x", "a\xa0b", "½3²µª", "x" * 500, "日本語 text", "éa"]
    want = [np.asarray(x, "<u4").tobytes() for x in e._ids(texts)]
    assert list(e.encode(texts)) == want and e.blocks is not None


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, k = rng.integers(1, 6), rng.integers(1, 4)
        s = rng.normal(0, 3, (n, k)).astype(np.float32)
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(value(p) for p in itertools.product(range(k), repeat=n))
        assert value(langid.path(s, 2.0)) == pytest.approx(best, abs=1e-4)


def test_language_labels():
    counts = np.zeros((2, langid.BUCKETS + len(langid.SCRIPTS)), np.int64)
    for i, text in enumerate(("the cat and the dog " * 20, "кот и собака " * 20)):
        code, _, _, script = langid.grams(next(langid.pieces(text)))
        counts[i] = np.append(np.bincount(code, minlength=langid.BUCKETS), np.bincount(script, minlength=len(langid.SCRIPTS)))
    m = langid.Model(["en", "ru"], counts)
    assert langid.label(m, None, 5.0) == langid.label(m, "12 !", 5.0) == ("und", 0.0, [])
    name, score, spans = langid.label(m, "the cat and the dog кот и собака кот", 5.0)
    assert name in ("en", "ru") and [s[2] for s in spans] == ["en", "ru"] and 0 < score < 1
    assert langid.label(langid.Model([], counts[:0]), "text", 5.0)[0] == "und"


def test_ranker_orders_and_thresholds():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    x = rng.normal(0, 1, (400, 6))
    x[:, 0] += 3 * y
    m = quality_rank.fit(x, y)
    s = m.score(x)
    assert ((s >= 0.7) == (y == 1)).mean() > 0.9 and ((0 <= s) & (s <= 1)).all()
    assert quality_rank.fit(x, np.ones(400, int)) is None
    assert np.isfinite(quality_rank.features(None)).all() and np.isfinite(quality_rank.features(b"\n\n x" * 50_000)).all()


def test_ranker_against_all_pairs():
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 300)
    x = rng.normal(0, 1, (300, 4)) + np.outer(y, [1, 0.5, 0, 0])
    m = quality_rank.fit(x, y)
    z = quality_rank.scaled(x, m.centre, m.scale)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 4)
    w = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(d @ w))
        w -= np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-4 * np.eye(4), 1e-4 * w - p @ d / len(d))
    assert np.abs(m.weights - w).max() < 0.02


def test_subsequence_and_answers():
    rng = random.Random(1)
    for _ in range(50):
        x, y = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(np.array(x, np.uint64), np.array(y, np.uint64)) == t[-1][-1]
    assert decontaminate.holds(np.array([2, 3]), np.array([1, 2, 3])) and not decontaminate.holds(np.array([3, 2]), np.array([1, 2, 3]))


def test_gradients_of_the_recurrent_model():
    rng = np.random.default_rng(0)
    net = recurrent_lm.Network(np.sort(rng.integers(1, 100, 150))[::-1])
    sequences = [rng.integers(0, 150, n).astype(np.int32) for n in (16, 11, 5)]
    grid = np.full((3, 17), 3, np.int32)
    for i, s in enumerate(sequences):
        grid[i, 1 : len(s) + 1] = s
    trainer, got = recurrent_lm.Trainer(net, 0.0), {}
    trainer._move = lambda k, g, rows=None: got.__setitem__(k, (g, rows))
    trainer._window(grid, np.array([16, 11, 5]), np.zeros((3, recurrent_lm.HIDDEN), np.float32))
    loss = lambda: -recurrent_lm.score_texts(net, sequences, 3).sum()
    for k, at in (("b", (50,)), ("b", (30,)), ("bc", (1,)), ("bo", (0, 5)), ("wc", (4, 1)), ("u", (2, 60))):
        w, old = getattr(net, k), getattr(net, k)[at]
        values = []
        for e in (0.01, -0.01):
            w[at] = old + e
            values.append(loss())
        w[at] = old
        assert float(got[k][0][at]) * math.sqrt(32) == pytest.approx((values[0] - values[1]) / 0.02, rel=0.05, abs=2e-3)


def test_recurrent_model_learns_and_carries_state():
    rng = np.random.default_rng(1)
    texts = [np.array([(i + j) % 7 for j in range(60)] + [7], np.int32) for i in rng.integers(0, 7, 300)]
    net = recurrent_lm.Network(np.full(8, 100))
    before = recurrent_lm.score_texts(net, texts, 7).sum()
    trainer = recurrent_lm.Trainer(net, 0.1)
    for _ in range(4):
        trainer.learn(texts, 7)
    assert recurrent_lm.score_texts(net, texts, 7).sum() > 0.5 * before
    probabilities = [math.exp(recurrent_lm.score_texts(net, [np.array([1, 2, x], np.int32)], 7)[0]) for x in range(8)]
    assert sum(probabilities) == pytest.approx(math.exp(recurrent_lm.score_texts(net, [np.array([1, 2], np.int32)], 7)[0]), rel=1e-3)


def test_table_look_up():
    words = np.unique(wordhash.mix(np.arange(5000, dtype=np.uint64)) >> np.uint64(8))
    v = recurrent_lm.Vocabulary(words, np.ones(5000, int), np.zeros(5000, np.int32), np.ones(3), 0, 1, 1, 1, 1, 0, 0)
    h = np.concatenate([words[::3], words[::5] + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
    at, there = v.look_up(h)
    assert there.tolist() == np.isin(h, words).tolist() and (words[at[there]] == h[there]).all()


def test_warc_parser_rejects_damage():
    import io

    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse(io.BytesIO(good * 2))] == [b"abc"] * 2
    for bad in (b"junk\r\n" + good, good[:-8]):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))


def test_search_does_not_depend_on_blocks(monkeypatch):
    """Texts handled together, or a long one in parts, give what each gives alone."""
    rng = np.random.default_rng(8)
    vocabulary = rng.integers(0, 2**63, 300).astype(np.uint64)
    draw = lambda n: vocabulary[np.minimum(rng.geometric(0.02, n), 300) - 1]
    words = [draw(n) for n in (3, 7, 20, 37, 60)]
    terms = np.unique(np.concatenate(words))
    texts = [draw(n) for n in (0, 1, 15, 16, 17, 100, 3000, 33, 0, 700)]
    texts[6][1000:1060] = words[4]
    texts[6][2500:2537] = words[3]
    texts[5][90:97] = words[1]
    texts[9] = np.concatenate([texts[9], words[2]])

    def run(slots, each):
        monkeypatch.setattr(decontaminate, "SLOTS", slots)
        items = decontaminate.Items(list(range(5)), words, [w[-8:] for w in words], terms, 32)
        items.weight = np.linspace(1, 3, len(terms))
        items.latent = np.random.default_rng(1).standard_normal((len(terms), 8)).astype(np.float32)
        vectors = np.array([items.latent[np.searchsorted(terms, w)].sum(0) for w in words])
        items.vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
        z = np.zeros((len(terms), 4))
        decontaminate._gram(items, each, np.linspace(-1, 1, len(terms) * 4).reshape(-1, 4), 1.0, z)
        return [(t, i, first, n, round(lcs, 9), a) for t, i, first, n, _, lcs, a in decontaminate.search(items, each, 0.4, 0.7, 0.5, 8, 5)], z

    whole, z = run(8192, texts)
    assert {(6, 4), (6, 3), (5, 1), (9, 2)} <= {x[:2] for x in whole}
    for slots in (2, 5, 64):
        got, other = run(slots, texts)
        assert got == whole and np.allclose(other, z, rtol=1e-4, atol=1e-3)
    assert [(t, *x[1:]) for t, h in enumerate(texts) for x in run(8192, [h])[0]] == whole


def test_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, y = (rng.integers(0, 12, n).astype(np.uint64) for n in rng.integers(0, 40, 2))
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1, j + 1] = table[i, j] + 1 if a == b else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common_subsequence(x, y) == table[-1, -1]


def test_paths_of_long_texts(monkeypatch):
    """A text in pieces has the labels, score and spans that it has in one."""
    rng = random.Random(3)
    counts = np.random.default_rng(4).integers(0, 50, (3, langid.BUCKETS + len(langid.SCRIPTS))) ** 3
    model = langid.Model(["a", "b", "c"], counts)
    for texts in (20, 400, 3000):
        text = "   ".join("".join(rng.choice("abcdeé\u0431\u4e00") for _ in range(rng.randint(1, 9))) for _ in range(texts))
        for penalty in (0.5, 12.0, 1e9):
            monkeypatch.setattr(langid, "PIECE", 1 << 20)
            whole = langid.label(model, text, penalty)
            for piece in (64, 500):
                monkeypatch.setattr(langid, "PIECE", piece)
                assert langid.label(model, text, penalty) == whole
    monkeypatch.setattr(langid, "PIECE", 4)
    assert langid.label(model, "1 2 3 4 5 6 x", 1.0)[2] == [(0, 1, langid.label(model, "x", 1.0)[0])]


def test_numbered_words_are_searched_like_hashes():
    rng = np.random.default_rng(3)
    vocabulary = rng.integers(0, 2**63, 400).astype(np.uint64)
    words = [rng.choice(vocabulary[:200], n) for n in (9, 30, 50)]
    answers = [words[0][-3:], vocabulary[300:303], words[2][-8:]]  # the second has words that no item has
    items = decontaminate.Items([0, 1, 2], words, answers, np.unique(np.concatenate(words)), 32)
    texts = [rng.choice(vocabulary, n) for n in (0, 40, 900)]
    texts += [np.concatenate([texts[1], words[0], words[1][:17], answers[1], texts[2]])]
    items.weight = np.ones(len(items.terms))
    items.latent = rng.standard_normal((len(items.terms), 8)).astype(np.float32)
    items.vectors = np.full((3, 8), 8**-0.5, np.float32)
    numbers = [items.numbers(h) for h in texts]
    assert all((items.hashes(k) == np.where(np.isin(h, items.table()), h, 0)).all() for k, h in zip(numbers, texts, strict=True))
    assert all((a == b).all() for k, h in zip(numbers, texts, strict=True) for a, b in zip(items.hits(k), items.hits(h), strict=True))
    one, two = (list(decontaminate.search(items, iter(x), 0.4, 0.7, 0.5, 8, 5)) for x in (texts, numbers))
    assert one == two and {x[:2] for x in one} == {(3, 0), (3, 1)}


def test_run_sums_against_reduceat():
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((50, 4))
    begin = np.append(0, np.cumsum(np.append(rng.integers(1, 6, 200), [300, 40])))
    pick = rng.integers(0, 50, begin[-1])
    assert np.allclose(decontaminate.run_sums(rows, pick, begin[:-1]), np.add.reduceat(rows[pick], begin[:-1], axis=0))


def test_scoring_steps_equal_training_steps():
    rng = np.random.default_rng(6)
    net = recurrent_lm.Network(np.sort(rng.integers(1, 100, 150))[::-1])
    net.b += rng.standard_normal(net.b.shape).astype(np.float32)
    ids, h = rng.integers(0, 150, 40), rng.uniform(-1, 1, (40, recurrent_lm.HIDDEN)).astype(np.float32)
    assert np.allclose(net.stepper()(ids, h), net.step(ids, h)[0], atol=1e-5)
