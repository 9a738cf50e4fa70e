import random

import numpy as np
import xxhash

from framewright.llm import components, product_quantisation, simhash


def plain_components(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(50)] + [(None, 1), (7, 7)]
    real = {(a, b) for a, b in links if a is not None and a != b}
    want = plain_components({x for l in real for x in l}, lambda a, b: (a, b) in real or (b, a) in real)
    got = components.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def fp(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w)] if len(w) < width else [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)]
    return sum(1 << b for b in range(64) if sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) * 2 > len(sh))


def test_fingerprints_and_classes(spark):
    rng = random.Random(2)
    base = " ".join(rng.choices(["alpha", "Beta", "gamma", "é", "delta"], k=400))
    rows = [(10, base), (11, base), (12, base + " x"), (12, base + " x"), (3, None), (4, ""), (5, " \n"), (None, base), (None, "alone null"), (6, "one"), (7, "one two"), (8, "a\u00a0b c d"), (9, "w " * 20000)]
    rows += [(100 + i, " ".join(rng.choices("abcdefgh", k=30))) for i in range(40)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, fp string, component long")
    got = simhash.report(df).collect()
    assert len(got) == len(rows)
    prints = {}
    for i, t in rows:
        prints.setdefault(fp(t), []).append(i)
    comp = plain_components(set(prints), lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for f, ids in prints.items():
        for i in ids:
            if i is not None:
                least[comp[f]] = min(least.get(comp[f], i), i)
    want = sorted(((i, f"{fp(t):016x}", least.get(comp[fp(t)])) for i, t in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert simhash.report(df.where("false")).count() == 0


def test_dense_blocks_are_split_without_losing_links(spark):
    rng = random.Random(3)
    centre, values = rng.getrandbits(64), set()
    for _ in range(300):
        v = centre
        for b in rng.sample(range(20), rng.randint(0, 4)):
            v ^= 1 << b
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(100)}
    signed = {int(np.array([v], np.uint64).view(np.int64)[0]): v for v in values}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = simhash.fingerprint_links(df, 3, part=16)
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    want = plain_components(set(signed), lambda a, b: bin(signed[a] ^ signed[b]).count("1") <= 3)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert all(simhash.block_plan(n, 3)[1] >= 1 for n in (1, 10**5, 10**9, 10**12))


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(4)
    vocabulary = ["w%d" % i for i in range(3000)]
    rows, gone = [], set()
    for g in range(60):
        words = rng.choices(vocabulary, k=rng.randint(60, 400))
        rows.append((g * 10, " ".join(words)))
        for k in range(1, 1 + g % 3):
            near = list(words)
            if k == 2:
                near[rng.randrange(len(near))] = "changed"
            rows.append((g * 10 + k, " ".join(near).upper() if k == 1 else " ".join(near)))
            gone.add(g * 10 + k)
    rows += [(0, rows[0][1]), (None, "no id"), (None, "no id"), (9001, None), (9002, "")]
    rows += [(9100, "two texts of one number " + " ".join(rng.choices(vocabulary, k=50))), (9100, "which are no copies " + " ".join(rng.choices(vocabulary, k=50))), (9101, rows[0][1])]
    gone.add(9101)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    kept = simhash.drop_copies(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted([*({i for i, _ in rows if i is not None} - gone - {9002}), 9100])
    assert ids.count(None) == 2
    assert simhash.drop_copies(df.where("false")).count() == 0


def test_near_copies_are_those_of_the_stated_similarity(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for g, (shared, own) in enumerate([(320, 40), (316, 42), (300, 50), (280, 60)] * 40):  # similarity 0.8, 0.79, 0.75, 0.7
        words = [f"w{g}x{i}" for i in range(shared + 4)]
        tail = lambda k: [f"{k}{g}y{i}" for i in range(own)]
        rows += [(2 * g, " ".join(words + tail("a"))), (2 * g + 1, " ".join(words + tail("b")))]
        want[g] = shared * 10 >= 8 * (shared + 2 * own)
    assert sum(want.values()) == 40
    rows += [(1000, "p q r s t u v w"), (1001, "p q r s t u v w x"), (1002, "same " * 9), (1003, "same " * 50)]  # ids above 2 x 160
    df = spark.createDataFrame([*rows, (2000, rows[0][1]), (2000, "another text of a repeated id")], "doc_id long, text string")
    simhash.VERIFY_ROWS, was = 1, simhash.VERIFY_ROWS
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_copies(df).collect()}
    simhash.VERIFY_ROWS = was
    assert not any(got[2 * g + 1] == 2 * g for g in want if not want[g])
    assert sum(got[2 * g + 1] == 2 * g for g in want if want[g]) >= 36  # at 0.8 just 3 % may be missed
    assert simhash.missed_share(0.8, 19, len(simhash.drawn_blocks(200_000, 0.8))) <= 0.03 and simhash.missed_share(0.9, 19, len(simhash.drawn_blocks(200_000, 0.8))) < 1e-3
    assert got[1003] == 1002


def test_equal_fingerprints_of_different_texts_are_compared():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [7, 8, 9, 10], [])]
    u, v = simhash.verified_links(np.arange(5), np.zeros((5, 4), np.uint64), sets, 69, 0.8)
    assert sorted(zip(u.tolist(), v.tolist())) == [(0, 1), (1, 2)]


def test_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12))
    x[50:110] = x[0] + 0.15 * rng.normal(size=(60, 12))
    x[110:130] = x[1]
    x[130:140] = x[1] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 12), (402, [float("nan")] + [1.0] * 11), (403, [None] + [1.0] * 11), (404, []), (405, [1.0, 2.0]), (None, x[2].tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "vec_id long, embedding array<double>, node string, list string").repartition(5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    full = np.vstack([unit, unit[2], unit[5]])
    names = [*range(300), None, 5]
    near = full @ full.T >= 0.9
    np.fill_diagonal(near, False)
    label = list(range(len(full)))
    while True:
        new = [min([label[i]] + [label[j] for j in np.flatnonzero(near[i])]) for i in range(len(full))]
        if new == label:
            break
        label = new
    least = {}
    for i, n in zip(label, names):
        least[i] = min((k for k in (least.get(i), n) if k is not None), default=None)
    want = [(n, int(near[k].sum()), least[label[k]]) for k, n in enumerate(names)] + [(i, 0, i) for i in (400, 401, 402, 403, 404, 405)]
    product_quantisation.BLOCK, was = 32, product_quantisation.BLOCK
    got = product_quantisation.near_vectors(df).collect()
    product_quantisation.BLOCK = was
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert product_quantisation.report(df.where("false")).count() == 0


def test_each_length_of_vectors_is_searched(spark):
    rows = [(i, [1.0, 0.01 * i, 0.0]) for i in range(4)] + [(10 + i, [0.5, 0.01 * i]) for i in range(3)] + [(20, [1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in product_quantisation.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{i: (3, 0) for i in range(4)}, **{10 + i: (2, 10) for i in range(3)}, 20: (0, 20)}


def skewed_vectors(rng, n, dims=64):
    """Uneven groups, a hot third in three dimensions, near copies, and near copies that move towards other groups."""
    centres = rng.normal(size=(40, dims))
    wide = centres[np.minimum(rng.geometric(0.08, n // 2), 40) - 1] + rng.normal(size=(n // 2, dims))
    turn = np.linalg.qr(rng.normal(size=(dims, 4)))[0]
    hot = turn[:, 0] * 3 + rng.uniform(-2, 2, size=(n // 3, 2)) @ turn[:, 1:3].T + 0.02 * rng.normal(size=(n // 3, dims))
    some = wide[rng.integers(0, len(wide), (n - len(wide) - len(hot)) // 2)]
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit(some) + 0.4 * rng.uniform(0.2, 1, (len(some), 1)) * unit(rng.normal(size=some.shape))
    moved = unit(some) + 0.4 * rng.uniform(0.2, 1, (len(some), 1)) * unit(centres[rng.integers(0, 40, len(some))])
    return np.concatenate([wide, hot, near, moved]).astype(np.float32)


def test_recall_on_many_uneven_lists(spark):
    rng = np.random.default_rng(10)
    x = skewed_vectors(rng, 20_000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    product_quantisation.PER_LIST, was = 400, product_quantisation.PER_LIST
    got = {r["vec_id"]: r for r in product_quantisation.report(df).collect()}
    product_quantisation.PER_LIST = was
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = np.concatenate([(unit[lo : lo + 1000] @ unit.T >= 0.9).sum(1) - 1 for lo in range(0, len(x), 1000)])
    mine = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (mine <= want).all() and mine.sum() >= 0.995 * want.sum(), mine.sum() / want.sum()
    apart = np.arange(len(x)) >= len(x) // 2 + len(x) // 3  # the near copies only
    assert mine[apart].sum() >= 0.99 * want[apart].sum(), mine[apart].sum() / want[apart].sum()
    assert all(r["component_id"] <= i and r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_full_reach_asks_every_list_that_holds_a_link():
    x = skewed_vectors(np.random.default_rng(11), 9000).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    product_quantisation.PER_LIST, was = 150, product_quantisation.PER_LIST
    index = product_quantisation.fit(x, len(x))
    product_quantisation.PER_LIST = was
    assert len(index.coarse) >= 50
    lists, d = index.nearest(x)
    some, extent = product_quantisation._extent(index, lists, d)
    whole = np.full((len(index.coarse), extent.shape[1]), np.inf)
    whole[:, -1], whole[some] = -np.inf, extent
    asked = np.zeros((len(x), len(index.coarse)), bool)
    for i, p in enumerate(product_quantisation._probes(index, d, lists, np.full(len(index.coarse), np.sqrt(0.2)), whole)):
        asked[i, p] = True
    for lo in range(0, len(x), 1000):
        a, b = np.nonzero(x[lo : lo + 1000] @ x.T >= 0.9)
        assert (asked[a + lo, lists[b]] | asked[b, lists[a + lo]]).all()


def test_short_links_ask_fewer_lists():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    product_quantisation.PER_LIST, was = 150, product_quantisation.PER_LIST
    index = product_quantisation.fit(x, len(x))
    product_quantisation.PER_LIST = was
    full, k = np.sqrt(0.2), len(index.coarse)
    lists, d = index.nearest(x)
    some, extent = product_quantisation._extent(index, lists, d)
    whole = np.full((k, k + 1), np.inf, np.float32)
    whole[some] = extent
    asked = lambda trial: sum(map(len, product_quantisation._probes(index, d, lists, product_quantisation._reach(index, x, trial, full), whole)))
    assert asked([(k, 0.2, 5000)]) < 0.7 * asked([])
    assert asked([(k, 0.2, 5)]) == asked([])  # a few links say nothing
    assert (product_quantisation._reach(index, x, [(3, 0.3, 0), (k, 0.2, 5000)], full)[3]) == 0.3 * product_quantisation.MARGIN
    y = x + rng.normal(size=x.shape) * 0.02  # links as long as those that were seen
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    theirs, dy = index.nearest(y)
    length = np.linalg.norm(x - y, axis=1)
    reach = product_quantisation._reach(index, x, [(k, length.max(), 5000)], full)
    mine, other = product_quantisation._probes(index, d, lists, reach, whole), product_quantisation._probes(index, dy, theirs, reach, whole)
    assert np.mean([b in m or a in o for a, b, m, o in zip(lists, theirs, mine, other)]) > 0.995
