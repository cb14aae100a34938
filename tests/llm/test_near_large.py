"""Near duplicates in nodes that stay large at the last depth, against all pairs."""

import random

from ferrule.llm import near


def test_single_links_among_many_that_are_nearly_linked(spark, monkeypatch):
    """300 sets, alike by 0.78 but for 100 pairs at 0.80: each of these has one link only, and all are to be found."""
    monkeypatch.setattr(near, "SMALL", 4)
    monkeypatch.setattr(near, "MASS", 60_000, raising=False)
    rng, rows = random.Random(5), []
    for i in range(300):
        pair = [f"pair{i // 2}x{j}" for j in range(12 if i < 200 else 0)]
        w = [f"all{j}" for j in range(700)] + pair + [f"own{i}x{j}" for j in range(100 - len(pair))]
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
    assert 100 * 712 >= 80 * (1600 - 712) and 100 * 700 < 80 * 900
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i - i % 2 if i < 200 else i for i in range(300)}


def test_blocks_against_all_pairs():
    rng = random.Random(7)
    sets = [sorted(rng.sample(range(60), rng.randint(1, 60))) for _ in range(120)]
    sets += [sorted({*s, 60 + i % 3} - {s[0]}) for i, s in enumerate(sets)]
    c = [b"%03d" % i for i in range(len(sets))]
    data = [near.np.array(s, dtype="<u8").tobytes() for s in sets]
    a, b = near.linked_across(c[:150], c[:150], data[:150], c, c, data, 80, 100)
    linked = {(x, y) for x in range(150) for y in range(len(sets)) if x != y and 100 * len({*sets[x]} & {*sets[y]}) >= 80 * len({*sets[x]} | {*sets[y]})}
    assert {(min(x, y), max(x, y)) for x, y in linked} >= {(int(x), int(y)) for x, y in zip(a, b, strict=True)}

    def roots(pairs):
        root = list(range(len(sets)))
        for x, y in pairs:
            p, q = root[x], root[y]
            root = [min(p, q) if r in (p, q) else r for r in root]
        return root

    assert roots((int(x), int(y)) for x, y in zip(a, b, strict=True)) == roots(linked)


def test_copies_close_to_the_threshold_are_all_pairs(spark):
    """1500 copies of one text, each with three words of its own: about a thousand of a million pairs are links."""
    from tests.llm.test_queries import components

    rng, own = random.Random(5), iter(range(10**9))
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(1500):
        w = list(base)
        for p in rng.sample(range(120), 3):
            w[p] = f"u{next(own)}"
        rows.append((i, " ".join(w)))
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(rows, 4)


def test_single_links_where_nodes_go_down_to_the_last_depth(spark, monkeypatch):
    monkeypatch.setattr(near, "LARGE", 8)
    test_single_links_among_many_that_are_nearly_linked(spark, monkeypatch)
