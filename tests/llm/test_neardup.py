import random
import re

import numpy as np
import pytest
from helpers import rows

from tessellum.llm import neardup

WORDS = [f"w{i}" for i in range(4000)]


def pair_set(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return set(zip(w, w[1:]))


def brute(data):
    sets = [(i, pair_set(t)) for i, t in data if i is not None and t is not None]
    out = set()
    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 2 * len(a & b) >= len(a | b):
                out.add((i, j))
    return out


def edited(rng, words):
    out = list(words)
    for _ in range(rng.randint(1, 3)):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [out[k], rng.choice(WORDS)]])
    return out


def corpus(seed, n, hot=0):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        base = [rng.choice(WORDS) for _ in range(rng.randint(20, 40))]
        data.append((f"{i:04d}-0", " ".join(base)))
        for k in range(rng.choice([0, 0, 1, 2])):
            data.append((f"{i:04d}-{k + 1}", " ".join(edited(rng, base))))
    stock = [rng.choice(WORDS) for _ in range(12)]
    for i in range(hot):
        data.append((f"hot{i:04d}", " ".join(stock + [rng.choice(WORDS) for _ in range(rng.randint(1, 4))])))
    return data


def found(spark, data, extra=""):
    return neardup.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in data], "id string, content string, cid string"))


def test_edited_copies(spark):
    data = corpus(3, 150)
    want = brute(data)
    got = set(rows(neardup.pairs_of_ids(found(spark, data))))
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 50


def test_long_runs_are_compared_in_squares(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LONG_RUN", 8)
    monkeypatch.setattr(neardup, "SQUARE", 16)
    data = corpus(5, 5, hot=60)
    want = brute(data)
    got = set(rows(neardup.pairs_of_ids(found(spark, data))))
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 500


def test_large_family_of_edited_copies(spark):
    """Over 1 % of more than 5 000 records are edited copies of one text, and over 1 % exact copies of another that has one edited copy."""
    rng = random.Random(11)
    base, other = ([rng.choice(WORDS) for _ in range(30)] for _ in range(2))
    family = [(f"f{i:03d}", " ".join(edited(rng, base))) for i in range(80)]
    copies = [(f"g{i:03d}", " ".join(other)) for i in range(80)] + [("h", " ".join(other[:9] + ["new"] + other[10:]))]
    rest = [(f"r{i:04d}", " ".join(f"u{i}x{k}" for k in range(25))) for i in range(5300)]
    want = brute(family + copies)
    got = set(rows(neardup.pairs_of_ids(found(spark, family + copies + rest))))
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 5000 and ("g000", "h") in got


def test_pairs_at_the_threshold(spark):
    """600 pairs of texts that share 20 of 40 word pairs."""
    data = []
    for i in range(600):
        words = [f"t{i}x{k}" for k in range(41)]
        data += [(f"{i:03d}a", " ".join(words[:31])), (f"{i:03d}b", " ".join(words[:21] + words[31:]))]
    want = {(f"{i:03d}a", f"{i:03d}b") for i in range(600)}
    got = set(rows(neardup.pairs_of_ids(found(spark, data))))
    assert got <= want and len(got) >= 0.995 * len(want)


def test_odd_rows(spark):
    text = "One two three four, FIVE!"
    data = [("b", text), ("a", "one  two three-four five"), ("a", "one  two three-four five"), ("c", None), (None, text), ("d", ""), ("e", "one"), ("f", "one one"), ("g", "one one one"), ("h", text + " six")]
    f = found(spark, data)
    assert rows(neardup.pairs_of_ids(f)) == [("a", "b"), ("a", "h"), ("b", "h"), ("f", "g")]
    assert rows(neardup.groups(f)) == [("a", "a", 1), ("b", "a", 1), ("f", "f", 0), ("g", "f", 0), ("h", "a", 1)]


def test_many_copies(spark, monkeypatch):
    data = [(f"c{i}", "x y z") for i in range(5)] + [("d", "x y z z"), ("e", "p q"), ("e2", "p q")]
    f = found(spark, data)
    assert set(rows(neardup.pairs_of_ids(f))) == brute(data)
    monkeypatch.setattr(neardup, "MOST_COPIES", 9)
    assert set(rows(neardup.pairs_of_ids(f, all_pairs=True))) == brute(data)
    got = set(rows(neardup.pairs_of_ids(f)))
    assert {("c0", f"c{i}") for i in range(1, 5)} <= got and ("c0", "d") in got and ("e", "e2") in got and len(got) < len(brute(data))
    assert {r["group_id"] for r in neardup.groups(f).collect()} == {"c0", "e"}
    want = [(f"c{i}", "c0", "d") for i in range(5)] + [("d", "d", "c0"), ("e2", "e", None)]
    assert rows(neardup.classes_and_links(f)) == sorted(want, key=repr)


@pytest.mark.parametrize("share", [0.01, 0.05, 0.2])
def test_boilerplate_groups(spark, share):
    """Texts of a 30-word boilerplate and 8 words of their own among others, above any share of all texts."""
    rng = random.Random(13)
    n = 2400
    stock = [f"s{i}" for i in range(30)]
    family = [(f"b{i:04d}", " ".join(stock + [rng.choice(WORDS) for _ in range(8)])) for i in range(max(60, int(share * n)))]
    rest = [(f"r{i:04d}", " ".join(f"u{i}x{k}" for k in range(25))) for i in range(n - len(family))]
    want = brute(family)
    got = set(rows(neardup.pairs_of_ids(found(spark, family + rest))))
    assert got <= want and len(got) >= 0.995 * len(want) and len(want) == len(family) * (len(family) - 1) // 2


@pytest.mark.parametrize("threshold", [0.35, 0.5, 0.8])
def test_recall_in_every_band_of_overlap(spark, threshold):
    """Pairs that share 20 to 40 of their word pairs, by band; the code follows from the threshold."""
    data, bands = [], {}
    for i in range(700):
        own = i % 21
        words = [f"t{i}x{k}" for k in range(41 + own)]
        data += [(f"{i:03d}a", " ".join(words[:41])), (f"{i:03d}b", " ".join(words[own:]))]
        overlap = (40 - own) / (40 + own)
        if overlap >= threshold:
            bands.setdefault(int(overlap * 10), set()).add((f"{i:03d}a", f"{i:03d}b"))
    f = neardup.near_duplicates(spark.createDataFrame(data, "id string, content string"), threshold=threshold)
    got = set(rows(neardup.pairs_of_ids(f)))
    assert got <= set().union(*bands.values())
    for band in bands.values():
        assert len(got & band) >= 0.97 * len(band)


def test_thresholds_out_of_range_are_refused(spark):
    with pytest.raises(ValueError):
        found_at = spark.createDataFrame([("a", "x y")], "id string, content string")
        neardup.near_duplicates(found_at, threshold=0.1)


def test_packed_anchors_come_back():
    rng = np.random.default_rng(1)
    for wide in (10, 1 << 20, 1 << 40):
        keys, cids = np.sort(rng.integers(0, 1 << 48, 500).astype(np.uint64)), rng.integers(0, wide, 500)
        kind, k, c = neardup._unpack(neardup._pack(neardup.ENTRIES, keys, cids))
        assert kind == neardup.ENTRIES and (k == keys).all() and (c == cids).all()


@pytest.mark.parametrize("data", [[], [("a", "x y")]])
def test_nothing_to_find(spark, data):
    f = found(spark, data)
    assert neardup.pairs_of_ids(f).count() == 0 and neardup.groups(f).count() == 0
