"""Conversation repair, hard negatives and URL filters by brute force and on awkward rows."""

import hashlib
import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenledger.llm import dialogue, multi_index, urls

# conversation repair


def cheapest(codes):
    """The least (cost, letters) by a search over all states, letters and costs."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, letters, i, state = heapq.heappop(heap)
        if i == len(codes) and state in (0, 3):
            return cost, letters
        if (i, state) in done:
            continue
        done.add((i, state))
        ways = [("I", 5, 0, to) for role, to in dialogue._NEXT[state].items() if role != "s"]
        if i < len(codes):
            kind, fault = codes[i] % 4, codes[i] // 4
            ways.append(("D", 2, 1, state))
            if fault not in (1, 2):
                for role, to in dialogue._NEXT[state].items():
                    if kind < 3 and "sua"[kind] == role:
                        ways.append(("K", 5 * (fault == 3), 1, to))
                    elif role != "s":
                        ways.append(("R", 1 + 5 * (fault == 3), 1, to))
        for letter, more, step, to in ways:
            heapq.heappush(heap, (cost + more, letters + letter, i + step, to))
    raise AssertionError


@pytest.mark.parametrize("block", [1, 2, 5, 16])
def test_plans_are_the_least_of_the_cheapest(block):
    rng = random.Random(block)
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 1, 2, 3, 5, 9, 13, 14, 12]) for _ in range(rng.randrange(0, 24)))
        assert dialogue.plan(codes, block) == cheapest(codes), codes


def test_prices_of_an_auction_are_feasible():
    codes = bytes([0, 2, 2, 13, 1, 5, 3])
    arcs = dialogue._lattice(codes, None)
    prices = [0] * len(arcs)
    dialogue.auction(arcs, prices, 0)
    assert all(prices[i] <= cost + prices[j] for i, out in enumerate(arcs) for _, cost, j in out)
    assert prices[0] == cheapest(codes)[0] and prices[-1] == 0


def test_a_long_conversation_is_planned_in_blocks():
    rng = random.Random(3)
    codes = bytes(rng.choice([1, 2, 2, 1, 14, 5]) for _ in range(100_000))
    cost, audit = dialogue.plan(codes)
    assert len(audit) - audit.count("I") == len(codes) and cost > 0
    written = "".join(before + ("" if own == "D" else "sua"[codes[n] % 4] if own == "K" else own) + after for n, (_, before, own, after) in enumerate(dialogue.steps(audit)))
    assert written == "ua" * (len(written) // 2)


TALK = "conv_id long, turn long, role string, text string, own string"


def talk_rows():
    return [
        (1, 0, "system", "Be brief.", "x"), (1, 1, "user", "Hi?", "x"), (1, 2, "assistant", "Hello!", "x"),
        (2, 3, "user", "no end", "x"), (2, 3, "user", "no end", "x"), (2, None, "assistant", None, "x"), (2, 9, None, "What.", "x"),
        (3, None, None, None, None), (3, None, "", "Text.", None),
        (None, 0, "user", "Who?", None), (None, 1, "assistant", "Me. \n\t", None), (None, 1, "assistant", "Me. \n\t", None),
        (4, 5, "tool", "An answer." + " x." * 50_000, None), (4, 6, "user", "\u00a0", None), (5, 0, "ufo", "Ends!", None), (5, 1, "agent", "Ends!", None),
    ]


def plainly(rows):
    """Facts and repaired lines of one conversation, row by row."""
    rows = sorted(((r[1], r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, codes, counts = set(), [], [0, 0, 0, 0]
    for turn, role, text in rows:
        solid = text.strip(dialogue.SPACE)
        fault = 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0
        seen.add((role, text))
        counts[fault] += 1
        codes.append(("sua".index(role[0]) if role and role[0] in "sua" else 3) + 4 * fault)
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = cheapest(bytes(codes))
    lines, at, system = [], 0, (len(audit) - audit.count("D")) % 2
    for letter in audit:
        fits = ("user", "assistant")[(len(lines) - system) % 2]
        if letter == "I":
            lines.append(f"{fits}:")
            continue
        if letter != "D":
            lines.append(f"{fits if letter == 'R' else rows[at][1]}:{rows[at][2]}")
        at += 1
    return (gaps, *counts[1:], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_repair_of_awkward_rows(spark):
    rows = talk_rows()
    frame = spark.createDataFrame(rows, TALK).withColumns({c: F.lit(7) for c in ("n", "code", "of", "place", "audit", "copy", "kind")})
    got = {r.conv_id: tuple(r)[1:] for r in dialogue.report(frame, frame).collect()}
    assert got == {conv: plainly([r for r in rows if r[0] == conv]) for conv in {r[0] for r in rows}}


def test_repaired_rows_read_as_they_should(spark, sf_dir):
    damaged = dialogue.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    facts, rows = dialogue.repair(damaged)
    by = {}
    for r in rows.orderBy("conv_id", "place").collect():
        by.setdefault(r.conv_id, []).append((r.place, r.role))
    for f in facts.collect():
        places = by.get(f.conv_id, [])
        initials = "".join(role[0] for _, role in places)
        assert [p for p, _ in places] == list(range(len(places)))
        assert initials == "" or initials.removeprefix("s") == "ua" * (len(initials) // 2) and len(initials) > 1


def test_repair_of_nothing_and_of_dropped_conversations(spark):
    nothing = spark.createDataFrame([], TALK)
    assert dialogue.report(nothing, nothing).collect() == [] and dialogue.damaged(nothing).collect() == []
    some = spark.createDataFrame([(1, 0, "user", "Hi.", None)], TALK)
    row = dialogue.report(some, nothing).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?", None) for c in range(40) for t in range(5)] + [(None, 3, None, "A.", None), (4, None, "user", None, None)]
    got = sorted(map(str, (tuple(r) for r in dialogue.damaged(spark.createDataFrame(rows, TALK)).collect())))
    expected = []
    for conv, turn, role, text, _ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        expected += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(map(str, expected))


# hard negatives


def whole(vector):
    return [int(np.floor(256 * float(x))) for x in vector]


def mined(rows, every, k=5, low=80):
    usable = [(i, label, whole(v)) for i, v, label in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    shown = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for anchor, label, q in usable:
        if anchor is None or anchor % every:
            continue
        positives = sorted(((dot(q, v), i) for i, other, v in usable if other == label and i != anchor), key=key)[:k]
        for p, positive in positives:
            negatives = sorted(((dot(q, v), i) for i, other, v in usable if other != label and low * p <= 100 * dot(q, v) <= 100 * p), key=key)[:k]
            out += [(anchor, positive, rank, i, shown(p), shown(s)) for rank, (s, i) in enumerate(negatives, 1)]
    return sorted(map(str, out))


VECTORS = "vec_id long, embedding array<float>, label int"


def crowd(rng, n, width, kinds=4):
    """Vectors around a few centres, so that windows are not empty; one of them given often."""
    centres = rng.normal(size=(3, width)) * 2
    vectors = [(centres[rng.integers(3)] + rng.normal(size=width) * 0.4).astype("f4").tolist() for _ in range(n)]
    return [(i, vectors[0] if rng.random() < 0.3 else v, int(rng.integers(kinds))) for i, v in enumerate(vectors)]


@pytest.mark.parametrize(("width", "shard", "codewords"), [(6, 50, 4), (7, 4096, 16), (1, 33, 3)])
def test_negatives_by_brute_force(spark, monkeypatch, width, shard, codewords):
    monkeypatch.setattr(multi_index, "BATCH", 20)
    rows = crowd(np.random.default_rng(width), 400, width)
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = multi_index.mine(frame, F.col("vec_id") % 20 == 0, F.col("label"), shard=shard, codewords=codewords, least=60, most_asking=7)
    assert sorted(str(tuple(r)) for r in got.collect()) == mined(rows, 20) != []


def test_negatives_of_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    rows = crowd(rng, 60, 3, 2)
    rows += [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [float("nan")] * 3, 1), (103, [float("inf"), 0.0, 0.0], 0), (104, [1.0, 1.0, 1.0], None), (105, [], 1), (106, [3.0], 0)]
    rows += [(None, [1.0, 2.0, 1.0], 0), (None, [1.0, 2.0, 1.0], 1), (110, [1e7, 1.0, 1.0], 0), (111, [1e30, -1e30, 3.0], 0), (112, [1e30, -1e30, 2.0], 1), (120, [2e30, 1e29, 0.0], 1), (120, [2e30, 1e29, 0.0], 1)]
    got = multi_index.mine(spark.createDataFrame(rows, VECTORS).withColumn("block", F.lit(1)), F.col("vec_id") % 10 == 0, F.col("label"), shard=16, least=20)
    assert sorted(str(tuple(r)) for r in got.collect()) == mined(rows, 10) != []


def test_cells_come_by_falling_bound_and_bound_their_rows():
    rng = np.random.default_rng(5)
    matrix = np.floor(rng.normal(size=(700, 9)) * 256)
    books = multi_index.fit(matrix[:200], 9, 5)
    shard = multi_index.Shard(list(range(700)), np.zeros(700, np.int64), matrix, books, 9)
    query = np.floor(rng.normal(size=9) * 256)
    cells = list(shard.cells(query))
    bounds = [b for b, _, _ in cells]
    assert bounds == sorted(bounds, reverse=True) and sum(e - s for _, s, e in cells) == 700
    assert all((shard.matrix[s:e] @ query).max() <= b for b, s, e in cells)


def test_a_walk_stops_before_the_last_cell():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 8)) * 3000
    matrix = np.floor(np.repeat(centres, 400, axis=0) + rng.normal(size=(3200, 8)))
    shard = multi_index.Shard(list(range(3200)), np.zeros(3200, np.int64), matrix, multi_index.fit(matrix[::10], 8, 8), 8)
    seen = []
    best = multi_index.Best(5)
    shard.cells = lambda q, own=shard.cells: (seen.append(c) or c for c in own(q))
    shard.search(-1, 0, matrix[0], [best], True)
    scores = matrix @ matrix[0]
    assert [-s for s, _, _ in best.rows] == sorted(scores.astype(int).tolist(), reverse=True)[:5]
    assert sum(e - s for _, s, e in seen) < 3200


def test_negatives_of_nothing(spark):
    assert multi_index.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 10 == 0, F.col("label")).collect() == []


# URLs


def judged(url, listed, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h), len(p), h, p, v) for h, p, v in listed if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2] + best[3], best[4] if best else default


PAGES = "page_id long, url string, host string"
LISTED = [("net", "/", "block"), ("a.net", "/en/", "allow"), ("a.net", "", "block"), ("b.c.org", "/x", "block"), ("b.c.org", "/x/y", "allow"), ("org", "/é/", "block")]


def url_rows():
    urls_ = [
        None, "", "a.net/en/", "http://A.NET/en/x?q#f", "https://www.a.net/EN/", "https://xa.net/en/", "ftp://b.c.org/x/y/z", "http://b.c.org/x/", "http://b.c.org",
        "http://c.org/\u00e9/1", "http://net", "http://net/", "http://net.", "http://.net/", "http://u:p@a.net:80/en/", "http://a.net://b.net/", "://", "http:///en/", "http://a.net?en/",
        "http://a.net#/en/", "http://" + "a." * 3000 + "net/q", "http://a.net/" + "long/" * 5000, "http://\u00c4.NET/en/", "http://a.net\n/en/", "x\n://a.net/en/\nb",
    ]
    return [(i % 20, u, "own") for i, u in enumerate(urls_)] + [(None, "http://a.net/en/", "own")] * 3


def test_urls_by_brute_force(spark):
    rows = url_rows()
    frame = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("own") for c in ("rule", "verdict", "pairs", "places", "input_row")})
    listed = spark.createDataFrame([*LISTED, ("A.net", "/en/", "allow"), (None, "/", "block"), ("", "/", "block"), ("b.c.org", None, "allow")], urls.LIST)
    known = [*LISTED, ("b.c.org", "", "allow")]
    got = sorted(str((r.input_row.page_id, r.input_row.url, r.host, r.path, r.rule, r.verdict)) for r in urls.judge(frame, listed).collect())
    assert got == sorted(str((i, u, *judged(u, known))) for i, u, _ in rows)


def test_urls_with_large_lists_and_no_list(spark):
    rng = random.Random(1)
    host = lambda: ".".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5))) + ".net"
    listed = {(host(), "/" + "xy"[: rng.randrange(3)]): rng.choice(["block", "allow"]) for _ in range(300)}
    known = [(*k, v) for k, v in listed.items()]
    rows = [(i, f"http://{host()}/{''.join(rng.choice('xyz') for _ in range(3))}", "") for i in range(400)]
    frame, table = spark.createDataFrame(rows, PAGES), spark.createDataFrame(known, urls.LIST)
    expected = sorted(str((i, *judged(u, known))) for i, u, _ in rows)
    assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in urls.judge(frame, table, ["page_id"]).collect()) == expected
    free = urls.judge(frame, table.limit(0), ["page_id"]).collect()
    assert len(free) == 400 and {(r.rule, r.verdict) for r in free} == {(None, "allow")}
    assert urls.judge(frame.limit(0), table, ["page_id"]).collect() == []


def test_a_crowded_filter_changes_no_verdict(spark, monkeypatch):
    """With one block for all keys, false positives go to the join and end there."""
    monkeypatch.setattr(urls, "build", lambda hashes, own=urls.build: own(hashes, most_bytes=64))
    listed = [(f"h{i}.net", "/", "block") for i in range(2000)]
    rows = [(i, f"http://h{i}.net/x", "") for i in range(1900, 2300)]
    got = sorted(str((r.page_id, r.rule)) for r in urls.judge(spark.createDataFrame(rows, PAGES), spark.createDataFrame(listed, urls.LIST), ["page_id"]).collect())
    assert got == sorted(str((i, f"h{i}.net/" if i < 2000 else None)) for i, _, _ in rows)


def test_filter_holds_its_keys_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(urls, "SEGMENT", 8)
    keys = np.random.default_rng(0).integers(-(2**62), 2**62, 20_000)
    made = urls.build(spark.createDataFrame([(int(k),) for k in keys[:10_000]], "hash long"))
    assert made.holds(keys[:10_000].view(np.uint64)).all() and made.holds(keys[10_000:].view(np.uint64)).mean() < 0.01
    assert made.lanes.nbytes <= 10_000 * urls.BITS // 8 + 64
