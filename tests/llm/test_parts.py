"""The operators' inner parts against brute force, without Spark."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from .conftest import awkward_rows, prose
from tokenledger.llm import darts, labelled, nbsvm, packing, rans, relative_lz, rules, tokens, toxicity
from tokenledger.llm import words as W
from tokenledger.llm.maxscore import Shard

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [r[1] for r in awkward_rows()]


def chunk(texts):
    (rows,) = list(W.each_chunk(pa.array(texts, pa.string()), 1 << 30))
    return rows


@pytest.mark.parametrize("size", [1, 50, 1 << 20])
def test_words_are_ascii_splits(size):
    found = []
    for rows in W.each_chunk(pa.array(TEXTS, pa.string()), size):
        words = rows.gather(np.arange(len(rows.starts)))
        found += [words[a:b] for a, b in zip(rows.bounds[:-1], rows.bounds[1:], strict=True)]
    assert found == [(t or "").encode().split() for t in TEXTS]


def test_hashes_are_equal_for_equal_words_and_windows():
    rows = chunk(TEXTS)
    words, hashes = rows.gather(np.arange(len(rows.starts))), rows.hashes()
    assert len(set(words)) == len(set(hashes.tolist())) == len(set(zip(words, hashes.tolist(), strict=True)))
    grams, at, row = W.windows(hashes, rows.bounds, 3)
    expected = [(i, tuple(words[j : j + 3])) for i, (a, b) in enumerate(zip(rows.bounds[:-1], rows.bounds[1:], strict=True)) for j in range(a, b - 2)]
    assert [(int(i), tuple(words[j : j + 3])) for i, j in zip(row, at, strict=True)] == expected
    assert len({g for _, g in expected}) == len(set(grams.tolist()))


def test_sliced_and_large_string_columns():
    column = pa.array(TEXTS, pa.large_string()).slice(3, 6)
    assert [int(n) for rows in W.each_chunk(column) for n in rows.counts] == [len((t or "").split()) for t in TEXTS[3:9]]


@pytest.mark.parametrize("cache", [5, 600_000])
def test_word_by_word_ids_equal_whole_texts(cache):
    encoder = tokens.Encoder(PATH, cache_words=cache)
    marks = ["A.B, c., d,. e... (f), g'll, é. …. x,y. Z. 's. <|endoftext|>.   　a. é. ", "́x ΣΣ. İ.", "a\x1cb\x85c"]
    texts = [t or "" for t in TEXTS] + marks
    whole = [e.ids + [9] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.rows(pa.array(texts), 9)] == whole
    assert [x.tolist() for x in tokens.Encoder(PATH, by_word=False).rows(pa.array(texts), 9)] == whole


@pytest.mark.parametrize("cache", [40, 700, 600_000])
def test_odd_words_have_the_ids_of_whole_texts(cache):
    rng = random.Random(11)
    pieces = [*"abzAKZ01.,;:!?&%$#-_()<>|'", "'s", "'LL", "...", "&&&", "\u0301", "\u0331", "\u0307", "İ", "ß", "ſ", "\u212a", "é", "Σ", "“", "\u200b", "\x85", "中"]
    texts = [" ".join("".join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(300)) for _ in range(40)]
    encoder = tokens.Encoder(PATH, cache_words=cache)
    whole = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for a in range(0, len(texts), 4):
        assert [x.tolist() for x in encoder.rows(pa.array(texts[a : a + 4]))] == whole[a : a + 4]


def test_words_are_encoded_once_whatever_their_capitals_and_last_marks(monkeypatch):
    encoder, sent = tokens.Encoder(PATH, cache_words=12), []
    encode = encoder._encode_words
    monkeypatch.setattr(encoder, "_encode_words", lambda found, *a: (sent.extend(found), encode(found, *a))[1])
    for text in ("one One, ONE&&& one... other", "other one.", "One this", "that those", "one again", "one &&&", "u v w x y", "y one", "p q r s t", "one t"):
        got = [x.tolist() for x in encoder.rows(pa.array([text]))]
        assert got == [encoder.tokenizer.encode(text, add_special_tokens=False).ids]
    assert max(len(encoder.known), len(encoder.recent)) <= 12 and sent.count("those") == 1
    assert sent.count("one") == 1  # it had been asked for when the cache was full, so it stayed
    assert not [x for x in sent if x != x.lower() or (x[0].isalpha() and not x.isalpha())]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 129, 70_000, 200_001])
@pytest.mark.parametrize("kinds", [1, 3, 5000])
def test_rans_round_trip(n, kinds):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, kinds - 1).astype(np.uint32)
    freq = rans.frequencies(np.bincount(ids))
    assert freq.sum() == 1 << rans.SCALE and (freq[np.unique(ids)] > 0).all()
    base = np.cumsum(freq, dtype=np.uint64) - freq
    symbols = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
    lanes = rans.lanes_for(n)
    block = rans.encode_block(ids, freq, base, lanes) | {"n_ids": n, "lanes": lanes}
    assert (rans.decode_block(block, freq, base, symbols) == ids).all()
    part = rans.CHECKPOINT_STEPS * lanes
    last = -(-n // part) - 1  # a part alone, from its checkpoint
    assert (rans.decode_block(block, freq, base, symbols, parts=range(last, last + 1)) == ids[last * part :]).all()
    block["checksums"][last] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.decode_block(block, freq, base, symbols)


def test_rans_frequencies_with_more_rare_ids_than_room():
    counts = np.concatenate([[10**9, 10**8], np.ones(500_000, np.int64)])
    freq = rans.frequencies(counts)
    assert freq.sum() == 1 << rans.SCALE and freq.min() == 1


def test_best_fit_and_its_bound():
    rng = np.random.default_rng(0)
    for _ in range(30):
        capacity = int(rng.integers(10, 200))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 60)))
        bins = packing.best_fit(lengths, capacity)
        fill = np.bincount(bins, lengths)
        assert fill.max() <= capacity and (np.unique(bins) == np.arange(len(fill))).all()
        assert packing.lower_bound(lengths, capacity) <= len(fill)
        offsets = packing._offsets(lengths, bins)
        for b in range(len(fill)):
            mine = sorted(zip(offsets[bins == b], lengths[bins == b], strict=True))
            assert all(x + n == y for (x, n), (y, _) in zip(mine, mine[1:])) and mine[0][0] == 0
    assert packing.lower_bound(np.array([60] * 7), 100) == 7  # area alone would say 5
    assert packing.lower_bound(np.array([34] * 9), 100) == 5  # rounding: two fit a bin


def test_best_fit_is_optimal_on_small_cases():
    def least(lengths, capacity):
        best = len(lengths)

        def put(i, room):
            nonlocal best
            if len(room) >= best:
                return
            if i == len(lengths):
                best = len(room)
                return
            for k in {r: j for j, r in enumerate(room) if r >= lengths[i]}.values():
                put(i + 1, room[:k] + [room[k] - lengths[i]] + room[k + 1 :])
            put(i + 1, [*room, capacity - lengths[i]])

        put(0, [])
        return best

    rng = random.Random(1)
    for _ in range(40):
        lengths = sorted((rng.randint(1, 30) for _ in range(7)), reverse=True)
        exact = least(lengths, 30)
        assert packing.lower_bound(np.array(lengths), 30) <= exact <= packing.best_fit(np.array(lengths), 30).max() + 1


def test_base_counts_by_brute_force():
    rng = random.Random(2)
    texts = TEXTS + ["\n".join(rng.choice(["a b", "a  b", "", "c", " ", "d e f"]) for _ in range(12)) for _ in range(30)] + [prose(rng, 60, 3) for _ in range(10)]
    found = rules.base_counts(chunk(texts))
    for i, t in enumerate(t or "" for t in texts):
        words = t.encode().split()
        grams = [tuple(words[j : j + 8]) for j in range(len(words) - 7)]
        covered = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)} if len(grams) < 200 else set()
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert found["n_words"][i] == len(words)
        assert found["word_chars"][i] == sum(len(w.decode()) for w in words)
        assert found["n_symbols"][i] == sum(c in "#*$%&|<>" for c in t)
        assert found["n_dup_lines"][i] == len(lines) - len(set(lines))
        assert found["n_repeat_words"][i] == len(covered)
        assert found["base_failed"][i] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_dart_signatures_agree_as_sets_do():
    rng = np.random.default_rng(3)
    for similarity in (0.5, 0.8):
        same = []
        for _ in range(25):
            both = int(round(2 * similarity / (1 + similarity) * 300))
            a = rng.integers(0, 2**63, 300, dtype=np.uint64)
            b = np.concatenate([a[:both], rng.integers(0, 2**63, 300 - both, dtype=np.uint64)])
            s = darts.signatures(np.concatenate([a, b]), np.array([0, 300, 600, 600]), 96)
            same.append((s[0] == s[1]).mean())
            assert not s[2].any()
        assert abs(np.mean(same) - similarity) < 0.04


def test_dart_signatures_with_weights():
    rng = np.random.default_rng(5)
    found, exact = [], []
    for _ in range(25):
        e = rng.integers(0, 2**63, 200, dtype=np.uint64)
        x, y = rng.random(200) * 4, rng.random(200) * 4
        x[rng.random(200) < 0.2] = 0
        s = darts.signatures(np.concatenate([e, e]), np.array([0, 200, 400]), 96, np.concatenate([x, y]))
        found.append((s[0] == s[1]).mean())
        exact.append(np.minimum(x, y).sum() / np.maximum(x, y).sum())
    assert abs(np.mean(found) - np.mean(exact)) < 0.04


def test_a_link_in_a_crowd_whose_signatures_agree_little():
    rng = np.random.default_rng(3)
    one = np.sort(rng.integers(0, 2**62, 9).astype(np.uint64))
    two = np.sort(np.append(one[:8], np.uint64(2**63)))  # 8 of 10 shared: exactly the threshold
    marks = rng.integers(0, 2**16, (3, 96)).astype("<u2")
    marks[:, :4] = marks[0, :4]  # one band, in which a third node makes the bucket a crowd
    marks[1, :58] = marks[0, :58]  # 58 of 96 coordinates agree
    sets = [one, two, np.sort(rng.integers(0, 2**62, 9).astype(np.uint64))]
    names = [bytes([k]) * 16 for k in range(3)]
    table = pa.table(
        {"node": pa.array(names, pa.binary()), "n": [9] * 3, "band": [0] * 3, "signature": pa.array([m.tobytes() for m in marks], pa.binary()), "elements": pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())}
        | {"component": pa.array(names, pa.binary()), "block": [0] * 3, "i": [0] * 3, "j": [0] * 3}
    )
    assert darts._across(table).to_pylist() == [{"a": names[0], "b": names[1]}]


def test_factors_cover_each_window_once_and_alike():
    rng = random.Random(6)
    passage = prose(rng, 45)
    texts = [prose(rng, 50) + " " + passage, passage + " " + prose(rng, 30), prose(rng, 19), None, passage]
    rows = chunk(texts)
    f = relative_lz.factors(rows)
    seen = [(int(r), int(s) + k) for r, s, n in zip(f["row"], f["start"], f["windows"], strict=True) for k in range(n)]
    assert seen == [(i, j) for i, n in enumerate(rows.counts) for j in range(max(n - 19, 0))]
    keys = [{k for r, k in zip(f["row"].tolist(), f["key"].tolist(), strict=True) if r == i} for i in range(5)]
    assert keys[4] and keys[4] <= keys[0] and keys[4] <= keys[1]  # a passage is cut alike wherever it stands


def test_longest_earlier_matches_and_their_parse():
    rng = random.Random(8)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(4, 15))] for _ in range(60)]
    width = 4
    words = np.array([w for t in texts for w in t], np.uint64)
    bounds = np.cumsum([0] + [len(t) for t in texts])
    windows = np.diff(bounds) - width + 1
    first = np.cumsum(windows) - windows
    start = np.concatenate([np.arange(b, b + n) for b, n in zip(bounds[:-1], windows, strict=True)])
    end = np.repeat(bounds[1:], windows)
    got = relative_lz.longest_earlier(words, start, end, np.zeros(len(start), np.int64), width)
    suffixes = [words[s:e].tolist() for s, e in zip(start, end, strict=True)]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    best = [max([common(x, y) for y in suffixes[:i]], default=0) for i, x in enumerate(suffixes)]
    assert got.tolist() == [n if n >= width else 0 for n in best]
    spans = relative_lz.greedy_factors(got, first, windows, width)
    covered = {(int(p), int(a) + k) for p, a, n in zip(*spans, strict=True) for k in range(n)}
    assert covered == {(p, a) for p, n in enumerate(windows) for a in range(n) if got[first[p] + a]}


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(7)
    slots = [np.unique(np.concatenate([rng.integers(0, 300, 20), [1000 + label]])) for label in (0, 1) for _ in range(60)]
    y = np.repeat([0, 1], 60)
    order = rng.permutation(120)
    model = nbsvm.fit([slots[i] for i in order], y[order])
    p = model.probability(slots)
    assert ((p >= 0.5) == y).all()
    assert nbsvm.fit([], np.array([])).probability([np.array([], np.int64)]).tolist() == [0.5]


def test_network_gradients():
    rows = chunk(["alpha beta gamma Loser!", "one two three four five", ""])
    net = toxicity.Network.new(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = toxicity.inputs(rows)
    vectors = net.embed(x).astype(np.float64)
    table, row = toxicity.window_table(x.bounds, x.number, len(vectors) - 1)
    y = np.array([1.0, 0, 0])
    assert row.tolist() == [0, 1, 2]

    def loss():
        z = net.run(vectors, table)
        return (np.log1p(np.exp(z)) - y * z).sum()

    kept = []
    z = net.run(vectors, table, kept)
    g, d_vectors = net.gradients(vectors, table, kept, 1 / (1 + np.exp(-z)) - y)
    rng = np.random.default_rng(0)
    for values, gradient in [(net.p[k], g[k]) for k in g] + [(vectors, d_vectors)]:
        for _ in range(3):
            i = tuple(rng.integers(0, n) for n in values.shape)
            if values is vectors and i[0] == len(vectors) - 1:
                continue
            old = values[i]
            values[i] = old + 1e-3
            up = loss()
            values[i] = old - 1e-3
            down = loss()
            values[i] = old
            assert abs((up - down) / 2e-3 - gradient[i]) < 1e-3


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 96, 97, 500):
        table, row = toxicity.window_table(np.array([0, n]), np.arange(n), 10**6)
        assert set(table[table < 10**6].tolist()) == set(range(n)) and (row == 0).all()
        assert len(table) == 1 + max(0, -(-(n - 64) // 32))


def test_network_learns_planted_words():
    rng = random.Random(8)
    y = np.array([i % 2 for i in range(200)])
    texts = []
    for label in y:
        words = prose(rng, 150, 300).split()
        if label:
            words[rng.randrange(150)] = rng.choice(["vile", "awful"])
        texts.append(" ".join(words).encode())
    net = toxicity.fit(texts[:160], y[:160], steps=200)
    rows = chunk([t.decode() for t in texts[160:]])
    assert ((net.probability(rows) >= 0.5) == y[160:]).mean() >= 0.9
    slim = net.slim()
    assert np.allclose(slim.whole().probability(rows), net.probability(rows))


def test_platt_orders_and_centres():
    scores, y = np.array([-2.0, -1, 0.1, -0.1, 1, 2]), np.array([0, 0, 1, 0, 1, 1])
    a, b = labelled.platt(scores, y)
    p = labelled.sigmoid(a * scores + b)
    assert a > 0 and p[0] < 0.5 < p[-1]


@pytest.mark.parametrize("size", [3, 1 << 20])
def test_maxscore_shards_by_brute_force(size):
    rng = np.random.default_rng(9)
    ids = [None if i == 4 else int(i) for i in rng.permutation(80)]
    matrix = rng.integers(-size, size + 1, (80, 12)).astype(np.int32)
    shards = [Shard(ids[a : a + 20], matrix[a : a + 20]) for a in range(0, 80, 20)]
    for q in range(10):
        best = []
        for shard in shards:
            best = shard.search(ids[q] if ids[q] is not None else -1, matrix[q].astype(np.int64), best, 5)
        query = matrix[q].astype(object)
        every = sorted((-int((query * matrix[i].astype(object)).sum()), ids[i] is None, ids[i] or 0) for i in range(80) if ids[i] != ids[q] or ids[i] is None and ids[q] is None)
        assert [x[:3] for x in best] == every[:5]


def test_maxscore_beyond_exact_doubles():
    big = 2**30 + 1
    shard = Shard([1, 2], np.array([[big, big], [big, big - 1]], np.int32))
    found = shard.search(7, np.array([big, big], np.int64), [], 2)
    assert [(-s, i) for s, _, i, _ in found] == [(2 * big * big, 1), (big * big + big * (big - 1), 2)]


def test_crc_of_ids_is_of_little_endian_words():
    ids = np.array([1, 256, 65536], np.uint32)
    assert zlib.crc32(ids.astype("<u4").tobytes()) == zlib.crc32(b"\1\0\0\0\0\1\0\0\0\0\1\0")
