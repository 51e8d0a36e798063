"""Each operator on awkward rows, an empty table and clashing columns, against brute force where it is not in SQL."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tokenledger.llm import darts, labelled, lm, maxscore, mixing, nbsvm, packing, rans, relative_lz, rules, toxicity
from tokenledger.session import new_path

from .conftest import SCHEMA, awkward_rows, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(rows, end):
    tokenizer = Tokenizer.from_file(PATH)
    return [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, end]) for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def words_of(text):
    return (text or "").encode().split()


# mixing


def test_mix_repeats_whole_rows(spark, clashing):
    sized = clashing.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"))
    plan = mixing.rates(sized).collect()
    out = mixing.mix(clashing)
    assert out.columns == clashing.columns
    expected = Counter()
    for r in plan:
        assert 0 <= r.copies <= 2 and r.target <= 2 * r.source_size + 1e-9
        expected[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +expected
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(clashing).collect()))


def test_mix_targets_fill_by_weight(spark):
    rows = [(f"s{i}", n) for i, n in enumerate([10, 1000, 50, 400, 0])] + [(None, 300)]
    got = {r.source: (r.source_size, r.target) for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    weights, cap = [3, 1, 2, 3, 1, 2], [2 * n for _, n in rows]
    target, left, open_ = [0.0] * 6, 1.5 * sum(n for _, n in rows), set(range(6))
    while True:  # share, cut off, share the excess again
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total >= cap[i]}
        if not over:
            break
        for i in over:
            target[i] = cap[i]
        left, open_ = left - sum(cap[i] for i in over), open_ - over
    for i in open_:
        target[i] = left * weights[i] / sum(weights[k] for k in open_)
    assert [got[s][0] for s, _ in rows] == [n for _, n in rows]
    assert [got[s][1] for s, _ in rows] == pytest.approx(target)


def test_mix_of_nothing(nothing):
    assert mixing.mix(nothing).count() == 0


# packing


def check_packing(placed, rows, capacity, end):
    expected = Counter()
    for doc_id, ids in whole_ids(rows, end):
        for k, at in enumerate(range(0, len(ids), capacity)):
            expected[doc_id, k, at, len(ids[at : at + capacity]), crc(ids[at : at + capacity])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == expected
    bins = {}
    for r in placed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= capacity
    return len(bins)


@pytest.mark.parametrize("partition", [6, 20_000])
def test_packing_places_every_piece(awkward, partition):
    pieces = packing.pieces(awkward, PATH, capacity=256)
    placed = packing.pack(pieces, capacity=256, partition_pieces=partition).collect()
    used = check_packing(placed, awkward_rows(), 256, packing.END)
    assert used <= packing.lower_bound(np.array([r.length for r in placed]), 256) + (3 if partition == 6 else 0)


def test_packing_exchange_helps(spark, sf):
    docs, _ = sf
    pieces = packing.pieces(docs, PATH)
    alone = packing.pack(pieces, partition_pieces=20, rounds=1).select("sequence_id").distinct().count()
    shared = packing.pack(pieces, partition_pieces=20).select("sequence_id").distinct().count()
    assert shared < alone


def test_packing_of_nothing(nothing):
    assert packing.pack(packing.pieces(nothing, PATH)).count() == 0


# coded files


def test_files_give_back_every_id(spark, awkward):
    path = new_path(spark, "test-rans")
    rans.store(awkward, path, PATH)
    rows = sorted(whole_ids(awkward_rows(), rans.END), key=lambda x: (x[0] is not None, x[0] or 0))
    got = rans.read(spark, path).orderBy("start").collect()
    assert sum(len(r.ids) // 4 for r in got) == sum(len(i) for _, i in rows)
    start = 0
    for r in got:
        assert r.start == start
        start += len(r.ids) // 4
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((d, np.array(i, "<u4").tobytes()) for d, i in rows)
    assert [r.doc_id for r in got] == [d for d, _ in rows]
    digests = {(r.start, r.n_tokens, r.ids_crc32) for r in rans.digest(spark, path).collect()}
    assert digests == {(r.start, len(r.ids) // 4, zlib.crc32(bytes(r.ids))) for r in got}


def test_files_of_nothing(spark, nothing):
    path = new_path(spark, "test-rans-empty")
    rans.store(nothing, path, PATH)
    assert rans.digest(spark, path).count() == 0


# substrings


def brute_substrings(rows, window=20):
    """Identical rows of one id are one document; other texts of one id are told apart by an order of their own."""
    seen, gone = {}, {}
    marks = {}
    for doc_id, text, *_ in rows:
        marks.setdefault((doc_id, text), relative_lz._text_marks(next(iter(relative_lz.W.each_chunk(relative_lz.pa.array([text or ""], relative_lz.pa.string())))))[0])
    for doc_id, text in sorted(marks, key=lambda k: (k[0] is not None, k[0] or 0, marks[k])):
        words = words_of(text)
        hit = set()
        for i in range(len(words) - window + 1):
            g = tuple(words[i : i + window])
            if g in seen:
                hit.update(range(i, i + window))
            seen.setdefault(g, 1)
        gone[doc_id, text] = [w for i, w in enumerate(words) if i not in hit]
    return gone


def test_substrings_by_brute_force(spark, clashing):
    expected = brute_substrings(awkward_rows())
    got = relative_lz.cleaned(clashing, "doc_id", "text").collect()
    assert len(got) == len(awkward_rows())
    for r in got:
        kept = expected[r.doc_id, r.text]
        assert (r.n_words, r.n_removed) == (len(words_of(r.text)), len(words_of(r.text)) - len(kept))
        if r.n_removed:
            assert r.kept_text.encode() == b" ".join(kept)
    out = relative_lz.remove(clashing)
    assert out.columns == clashing.columns and out.schema["n_chars"].dataType == clashing.schema["n_chars"].dataType
    assert Counter((r.doc_id, b" ".join(words_of(r.text))) for r in out.collect()) == Counter((r[0], b" ".join(expected[r[0], r[1]])) for r in awkward_rows())
    assert {r.text for r in out.collect() if r.doc_id == 1} == {None}


def test_substrings_of_crossing_passages(spark):
    import random

    rng = random.Random(11)
    pool = [prose(rng, 30, 50) for _ in range(6)]  # few words, so that short runs repeat by chance
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randrange(0, 25), 50)]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(pool).split()
            a = rng.randrange(0, 10)
            parts += [" ".join(p[a : a + rng.randrange(5, 30)]), prose(rng, rng.randrange(0, 6), 50)]
        rows.append((i, " ".join(parts), "en", "a", 1))
    rows += [(200, " ".join(["la"] * 70), "en", "a", 1), (201, " ".join(["la"] * 30 + ["x"] + ["la"] * 30), "en", "a", 1)]
    expected = brute_substrings(rows)
    got = relative_lz.cleaned(spark.createDataFrame(rows, SCHEMA).repartition(7), "doc_id", "text").collect()
    assert {r.doc_id: r.n_removed for r in got} == {d: len(words_of(t)) - len(k) for (d, t), k in expected.items()}
    for r in got:
        if r.n_removed:
            assert r.kept_text.encode() == b" ".join(expected[r.doc_id, r.text])


def test_crowded_anchors_give_the_same_windows(spark):
    rng = random.Random(5)
    passage = prose(rng, 26, 40)
    rows = [(None if i % 3 else i, f"{prose(rng, i % 9, 40)} {passage} {prose(rng, i % 7, 40)}", "en", "a", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)

    def found(**sizes):
        spans = relative_lz.duplicate_windows(docs, **sizes).collect()
        return {(r.doc, r.at + k) for r in spans for k in range(r.windows)}

    whole = found()
    assert whole and whole == found(block_passages=3) == found(crowd=1) == found(block_passages=5, crowd=40)


def test_substrings_of_nothing(nothing):
    assert relative_lz.remove(nothing).count() == 0


# near duplicates


def brute_classes(rows):
    sets = []
    for _, text, *_ in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 10 * both >= 8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    return [sorted(m) for m in members.values()]


def test_near_duplicates_by_brute_force(spark):
    import random

    rng = random.Random(13)
    rows = list(awkward_rows())
    for family in range(3):  # chains of copies, each changed a little more
        words = prose(rng, 120, 5000).split()
        for k in range(25):
            words = list(words)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"z{family}.{k}.{rng.random()}"
            rows.append((100 + 30 * family + k, " ".join(words), "en", "a", 1))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("own"))
    got = Counter((r.doc_id, r.class_id) for r in darts.classes(docs).collect())
    expected = Counter()
    for m in brute_classes(rows):
        ids = [rows[i][0] for i in m if rows[i][0] is not None]
        expected.update((rows[i][0], min(ids) if ids else None) for i in m)
    assert got == expected
    kept = darts.keep_one(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    blank = sum(not words_of(r[1]) for r in rows)
    assert len(kept) == len(brute_classes(rows)) and sum(not words_of(r.text) for r in kept) == blank
    assert len({r.text for r in kept if words_of(r.text)}) == len(kept) - blank


def test_near_duplicates_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(14)
    base = prose(rng, 80, 5000).split()
    rows = []
    for k in range(40):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"z{k}.{rng.random()}"
        rows.append((k, " ".join(words), "en", "a", 1))
    monkeypatch.setattr(darts, "BLOCK", 5)
    got = {r.doc_id: r.class_id for r in darts.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: m[0] for m in brute_classes(rows) for i in m}


def test_near_duplicates_of_nothing(nothing):
    assert darts.classes(nothing).count() == 0 and darts.keep_one(nothing).count() == 0


# quality rules and classifiers


def test_rules_keep_whole_rows(clashing, labels):
    model = rules.train(clashing, labels)
    out = rules.filter(clashing, model)
    judged = rules.judge(clashing, model, rules.KEEP, "doc_id").collect()
    assert len(judged) == clashing.count() and out.columns == clashing.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in judged if r.kept)
    assert all(not r.kept for r in judged if r.base_failed)


def test_models_without_rows_are_neutral(nothing, awkward, labels):
    none = labels.filter("doc_id < 0")
    assert rules.judge(nothing, rules.train(nothing, none), rules.KEEP, "doc_id").count() == 0
    assert {r.score for r in nbsvm.score(awkward, nbsvm.train(awkward, none)).collect()} == {0.5}
    assert {r.score for r in toxicity.score(awkward, toxicity.train(awkward, none)).collect()} == {0.5}
    assert nbsvm.score(nothing, nbsvm.train(nothing, none)).count() == toxicity.score(nothing, toxicity.train(nothing, none)).count() == 0


def test_scores_of_awkward_rows(awkward, labels):
    for module, label in ((nbsvm, "quality"), (toxicity, "toxic")):
        scores = module.score(awkward, module.train(awkward, labels, label)).collect()
        assert len(scores) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in scores)
        same = {(r.doc_id, r.score) for r in scores if r.doc_id in (1, 2, 5)}
        assert len(same) == 3 and len({s for d, s in same if d in (1, 2)}) == 1


def test_sample_is_bounded_and_balanced(sf):
    docs, labels = sf
    rows = labelled.sample(docs, labels, "quality", (9, 7), labelled.id_crc32(F.col("sample_id")) % 3 != 1).collect()
    assert Counter(r.label for r in rows) == {0: min(9, sum(r.label == 0 for r in rows)), 1: 7}
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in rows)


def test_held_out_accuracy(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    train = labelled.id_crc32(F.col("sample_id")) % 3 != 1
    scores = nbsvm.score(docs, nbsvm.train(docs, labels, where=train)).join(labels, "doc_id").filter(labelled.id_crc32(F.col("doc_id")) % 3 == 1).collect()
    assert np.mean([(r.score >= 0.5) == r.quality for r in scores]) >= 0.97
    judged = rules.judge(docs, rules.train(docs, labels), rules.KEEP, "doc_id").join(labels, "doc_id").filter("not base_failed").collect()
    assert np.mean([r.kept == r.quality for r in judged]) >= 0.97


def test_toxic_words_are_learned(spark):
    import random

    rng = random.Random(15)
    rows = []
    for i in range(600):
        words = prose(rng, rng.randrange(20, 400), 800).split()
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vile", "awful", "Nasty!", "rotten,"])
        rows.append((i, " ".join(words), "en", "a", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    held = labelled.id_crc32(F.col("doc_id")) % 5 == 0
    scores = toxicity.score(docs, toxicity.train(docs, labels, where=labelled.id_crc32(F.col("sample_id")) % 5 != 0)).filter(held).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in scores]) >= 0.95


# language models


def test_losses_of_awkward_rows(clashing, labels):
    scored = lm.losses(clashing.withColumns({c: F.lit(1) for c in ("block", "slice", "doc_ids", "tokens", "words")}), labels.filter("quality = 1")).collect()
    assert len(scored) == len(awkward_rows())
    assert all(r.score == 0 and r.n_tokens == 0 for r in scored if r.doc_id in (1, 2, 3))
    assert all(np.isfinite(r.score) and r.score == r.target_loss - r.background_loss for r in scored)


def plain_losses(rows, targets):
    """Losses of ``(doc_id, text)`` rows under models of all words and pairs seen twice."""
    texts = [(i, (t or "").split(), i in targets) for i, t in rows]
    words = Counter(w for _, ws, _ in texts for w in ws)
    named = [(i, [w if words[w] >= lm.LEAST else "?" for w in ws], goal) for i, ws, goal in texts]
    size, out = sum(c >= lm.LEAST for c in words.values()), [[], []]
    seen = Counter(p for _, ws, _ in named for p in zip(["^", *ws], ws))
    for k in range(2):
        own = [ws for _, ws, goal in named if goal or k]
        one, two = Counter(w for ws in own for w in ["^"] * bool(ws) + ws), Counter(p for ws in own for p in zip(["^", *ws], ws))
        total = sum(map(len, own))
        for _, ws, _ in named:
            loss = [-np.log((two[p] * (seen[p] >= lm.LEAST) + lm.MASS * (one[p[1]] + 1) / (total + size + 1)) / (one[p[0]] + lm.MASS)) for p in zip(["^", *ws], ws)]
            out[k].append(sum(loss) / max(len(ws), 1))
    return [(i, len(ws), *x) for (i, ws, _), *x in zip(named, *out)]


def same_losses(got, expected):
    key = lambda r: (r[0] is None, r[0] or 0, *map(lambda x: round(x, 6), r[1:4]))
    got, expected = sorted(map(key, map(tuple, got))), sorted(map(key, expected))
    assert [x[:3] for x in got] == [x[:3] for x in expected]
    assert np.allclose([x[3:] for x in got], [x[3:] for x in expected], atol=2e-6)


def test_losses_keep_rare_words_and_pairs_of_large_inputs(spark):
    """Beyond 2 million tokens a share of all tokens is more than two occurrences; words seen twice count all the same."""
    from tokenledger.llm.queries import op2_lm
    from tokenledger.session import new_path

    rows = [(i, "a b " * 150_000) for i in range(10)] + [(20, "rare pair a"), (21, "b rare pair once"), (22, None)]
    path = new_path(spark, "lm-test")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(20, 1), (0, 0)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    same_losses(op2_lm(spark, path).collect(), plain_losses(rows, {20}))


def test_losses_by_brute_force(spark, awkward, labels, nothing, monkeypatch):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    targets = {r.doc_id for r in labels.filter("quality = 1 and doc_id is not null").collect()}
    for tokens, keys in ((2_000_000, 2_000_000), (50, 70)):  # one block and slice, and many
        monkeypatch.setattr(lm, "SLICE_KEYS", keys)
        monkeypatch.setattr(lm, "BLOCK_TOKENS", tokens)
        same_losses(lm.losses(awkward.repartition(3), labels.filter("quality = 1")).collect(), plain_losses(rows, targets))
    assert lm.losses(nothing, labels).count() == 0


# search


def test_search_by_brute_force(spark):
    rng = np.random.default_rng(16)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300, None), (350, [1.0, None] * 4), (400, [float("nan")] * 8), (450, [float("inf")] * 8), (500, []), (550, [0.5, 1.5]), (None, rows[0][1]), (100, rows[3][1]), (2, rows[2][1])]
    got = maxscore.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("own")), F.col("vec_id") % 50 == 0, shard=32, least=64)
    use = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = Counter()
    for q, a in use:
        if q is not None and q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for i, b in use if i != q)
            expected.update((q, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(scores[:5]))
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == expected


def test_search_of_large_finite_vectors(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=4).astype("f4").tolist()) for i in range(150)]
    rows += [(150, [1e7, -1.0, 2.0, 0.5]), (151, [1e30, 1e30, -1e30, 1.0]), (152, [1e30, 1e30, -1e30, 2.0]), (200, [3e38, 3e38, 3e38, 3e38]), (201, [-3e38, 1e-30, 1.0, 2.0]), (202, [2e7, 8388608.0, 0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = {r.vec_id: [int(np.floor(256 * float(x))) for x in r.embedding] for r in frame.collect()}
    expected = []
    for q in (i for i in whole if i % 50 == 0):
        scores = sorted(((-sum(x * y for x, y in zip(whole[q], v)), i) for i, v in whole.items() if i != q))[:5]
        expected += [(q, rank, i, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, i) in enumerate(scores, 1)]
    got = maxscore.search(frame.repartition(3), F.col("vec_id") % 50 == 0, shard=16, least=40, most_asking=2)
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_search_of_nothing_and_few(spark):
    kind = "vec_id long, embedding array<float>"
    assert maxscore.search(spark.createDataFrame([], kind), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], kind)
    assert [tuple(r) for r in maxscore.search(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]


# the pipeline


def test_pipeline_stages_follow_their_operators(spark, sf_dir):
    from tokenledger.llm.tables import stage

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for name, function in corpus_pipeline.STAGES:
        tables.append(stage(function(spark, tables[-1], sf_dir), f"test-{name}"))
    raw, kept, single, cut, mixed, packed = [t.collect() for t in tables]
    assert all(t.columns == docs.columns for t in tables[:-1])

    fine = {r.doc_id for r in kept}
    assert fine <= {r.doc_id for r in raw} and all(len(words_of(r.text)) >= 20 for r in kept)
    firsts = {min(kept[i].doc_id for i in m) for m in brute_classes([tuple(r) for r in kept])}
    assert {r.doc_id for r in single} == firsts and len(single) == len(firsts)
    gone = brute_substrings([tuple(r) for r in single])
    assert {r.doc_id: words_of(r.text) for r in cut} == {d: k for (d, _), k in gone.items()}
    counts = Counter(r.doc_id for r in mixed)
    assert set(counts) <= {r.doc_id for r in cut} and max(counts.values()) <= 2
    assert abs(sum(len(words_of(r.text)) for r in mixed) / sum(len(words_of(r.text)) for r in cut) - 1.5) < 0.05
    used = check_packing(packed, [tuple(r) for r in mixed], packing.CAPACITY, packing.END)
    assert used == packing.lower_bound(np.array([r.length for r in packed]), packing.CAPACITY)


def test_pipeline_of_awkward_rows(spark, awkward, labels, tmp_path):
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_digest_of_kept_words(spark, awkward, tmp_path):
    from tokenledger.llm.queries import op6_substrings

    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    expected = Counter((d, hashlib.sha256(b" ".join(k)).hexdigest()) for r in awkward_rows() for (d, t), k in [((r[0], r[1]), brute_substrings(awkward_rows())[r[0], r[1]])])
    assert Counter((r.doc_id, r.kept_sha256) for r in op6_substrings(spark, str(tmp_path)).collect()) == expected
