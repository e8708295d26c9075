import random

import pytest
from pyspark.sql import functions as F

from plateflow.llm import jaccard_join
from tests.llm import brute


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_matches_brute_force(docs):
    assert result(jaccard_join.join_near(docs)) == brute.near([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("seed,leaders", [(1, (1, 64)), (2, (1, 2, 3))])
def test_clusters_and_shared_passages(rows, seed, leaders, monkeypatch):
    """Copies, chains of near copies around the bar, and texts that share a long passage only."""
    monkeypatch.setattr(jaccard_join, "LEADERS", leaders)
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 4) + rng.choice("uvwxyz")
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(14):
        base = [word() for _ in range(rng.randint(1, 160))]
        if rng.random() < 0.5:
            base += passage
        texts.append(base)
        for _ in range(rng.randint(0, 9)):
            now = list(rng.choice(texts[-3:]))
            for _ in range(rng.randint(0, 1 + len(now) // 30)):
                now[rng.randrange(len(now))] = word()
            texts.append(now + [word() for _ in range(rng.randint(0, 4))])
    data = [(i, " ".join(t).upper() if i % 5 == 0 else "\n".join(t)) for i, t in enumerate(texts)]
    assert result(jaccard_join.join_near(rows("doc_id bigint, text string", data))) == brute.near(data)


def test_odd_rows(odd, empty):
    got = jaccard_join.join_near(odd)
    assert got.count() == odd.count()
    want = brute.near([(r["doc_id"], r["text"]) for r in odd.filter("doc_id IS NOT NULL").collect()])
    assert result(got.filter("doc_id IS NOT NULL")) == want
    assert jaccard_join.join_near(empty).count() == 0


def test_prefix_never_misses():
    """Any two sets at or above the bar share a signature, whatever is frequent."""
    import numpy as np

    rng = np.random.default_rng(3)
    hot = rng.integers(0, 256, 1 << (jaccard_join.HOT_BITS - 3), dtype=np.uint8)
    for _ in range(400):
        n = int(rng.choice([1, 2, 3, 4, 6, 9, 20, 30, 33, 60, 100, 127, 130, 300, 600]))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        drop = int(rng.integers(0, n // 4 + 1))
        b = a[rng.permutation(len(a))[drop:]]
        room = int(len(b) / 0.75 - len(a))
        b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, max(0, int(rng.integers(0, room + 1)) if room > 0 else 0), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            assert set(jaccard_join.signatures(a, hot).tolist()) & set(jaccard_join.signatures(b, hot).tolist())


def test_near_copies_make_about_one_pair_each(rows, monkeypatch):
    """Copies are in many groups, each with leaders of its own; not every leader is compared with every copy."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(200)]
    data = []
    for i in range(150):
        now = list(base)
        for _ in range(3):
            now[rng.randrange(len(now))] = word()
        data.append((i, " ".join(now)))
    made, plain = [], jaccard_join.staged

    def counted(df, name, *more):
        out = plain(df, name, *more)
        if name in ("nearest", "plausible"):
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "staged", counted)
    assert result(jaccard_join.join_near(rows("doc_id bigint, text string", data))) == brute.near(data)
    assert sum(made) < 1.5 * len(data), made


def test_little_is_shuffled(rows, monkeypatch):
    """17 bytes a signature; a set goes once to each group it is in, whether it leads there or not."""
    import numpy as np

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    data = [(i, " ".join(word() for _ in range(rng.choice([1, 4, 5, 40, 300])))) for i in range(60)]
    made = sum(len(jaccard_join.signatures(jaccard_join.shingle_set(text), None)) for _, text in data)
    hot = np.zeros(1 << (jaccard_join.HOT_BITS - 3), np.uint8)
    dealt = jaccard_join._dealt(rows("doc_id bigint, text string", data), hot, 4, 5, 75)
    sent = dealt.agg(F.sum(F.length("s")), F.sum(F.length("c")), F.sum(F.length("n"))).first()
    assert sent[0] == 8 * made and sum(sent) == 17 * made

    # Groups of 5 members that all lead, and one of 30 in several stretches with 4 leaders.
    monkeypatch.setattr(jaccard_join, "STRETCH", 7)
    groups = [(g, 5 * g + i) for g in range(8) for i in range(5)] + [(9, i) for i in range(30)]
    members = rows("gid bigint, rep bigint, n bigint, component bigint", [(g, r, 40, r) for g, r in groups])
    leaders = members.filter("gid < 9 OR rep < 4")
    same = jaccard_join.sketch(np.arange(40, dtype=np.uint64))
    classes = rows("rep bigint, n bigint, sketch binary", [(r, 40, bytearray(same)) for r in range(40)])
    seen, plain = [], type(members).sortWithinPartitions
    monkeypatch.setattr(type(members), "sortWithinPartitions", lambda self, *c: seen.append(self.count()) or plain(self, *c))
    pairs = {(p["a"], p["b"]) for p in jaccard_join._plausible(members, leaders, classes, 75).collect()}
    want = {(max(x, y), min(x, y)) for g, x in groups for h, y in groups if g == h and x != y and (g < 9 or y < 4)}
    assert pairs == want
    assert seen == [len(groups) + 4 * (5 - 1)]
