"""Large groups: near copies and shared passages must lose no link, and hot content no removal."""

import random

import pytest

from tallyward.llm import jaccard, lines, suffixes


def family(seed):
    """Near copies of one text, texts that share a passage, and texts in between."""
    rng = random.Random(seed)
    fresh = iter(range(10**9))
    base = [f"b{i}" for i in range(130)]
    passage = [f"p{i}" for i in range(60)]
    out = []
    for _ in range(45):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
            copy[rng.randrange(len(copy))] = f"x{next(fresh)}"
        out.append(copy)
    for _ in range(30):
        own = [f"y{next(fresh)}" for _ in range(rng.choice([5, 12, 18, 25, 60, 90]))]
        out.append(own + passage if rng.random() < 0.5 else passage + own)
    for k in range(12):
        out.append(base[: 130 - 6 * k] + [f"z{next(fresh)}" for _ in range(4)])
    rng.shuffle(out)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_keys_lose_no_link(spark, shingles, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "CROWD", 3)
    rows = family(seed)
    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in sets:
        for b in range(a + 1, len(sets)):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    found = {r.doc_id: r.component_id for r in got.collect()}
    assert found == {i: find(i) for i in sets}
    assert len(set(found.values())) < len(found) - 40


def test_a_hot_line_is_removed_everywhere_but_first(spark):
    hot = "this very line stands in each and every document of them all"
    near = [hot.replace(" very ", f" v{i} ") for i in range(40)]
    rows = [(i, f"own {i} start\n{hot if i % 2 else near[i // 2 % 40]}\nown {i} end") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: r.text for r in lines.without_copies(docs).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == f"own {i} start\nown {i} end" for i in range(1, 120))


@pytest.mark.parametrize("hot", [3, 10**6])
def test_a_hot_passage_is_removed_everywhere_but_first(spark, monkeypatch, hot):
    if hasattr(suffixes, "HOT"):
        monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    rows = [(i, "".join(rng.choice("stuvwxyz ") for _ in range(150)) + passage + "".join(rng.choice("lmnopqr ") for _ in range(150))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    seen, got = set(), {r.doc_id: bytes(r.kept) for r in suffixes.without_repeats(docs).collect()}
    for i, text in rows:
        data, cover = text.encode(), bytearray(len(text))
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                cover[k : k + 100] = b"\1" * 100
            seen.add(data[k : k + 100])
        assert got[i] == bytes(x for x, c in zip(data, cover, strict=True) if not c)
    assert len(got[5]) < 320
