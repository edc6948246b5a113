import random

import xxhash

from gleaner.llm.simhash import fingerprint, links, near_duplicates


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\f\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randint(0, 400)}É" for _ in range(rng.randint(1, 300))] for _ in range(12)]
    rows = []
    for i in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "Edit"
        rows.append((i + 5, rng.choice([" ", "\n", "\t  "]).join(words)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, " "), (204, "One"), (205, "one two"), (206, "ONE two"), (207, rows[0][1]), (3, rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as c").repartition(5)
    fps = {d: plain_fingerprint(t) for d, t in rows}
    want = groups(fps, 2)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in near_duplicates(df).collect()}
    assert got == {d: (fps[d], want[d]) for d in fps}
    assert near_duplicates(df.limit(0)).count() == 0
    again = near_duplicates(df.union(df)).collect()
    assert len(again) == 2 * len(rows) and {(r.doc_id, r.component_id) for r in again} == {(d, want[d]) for d in want}


def test_links_in_crowded_keys(spark):
    rng = random.Random(3)
    for radius in (2, 3, 5):
        fps = {rng.getrandbits(64) for _ in range(30)}
        for f in list(fps)[:6]:
            for _ in range(40):
                g = f
                for b in rng.sample(range(64), rng.randint(1, 4)):
                    g ^= 1 << b
                fps.add(g)
        signed = [x - (1 << 64) if x >> 63 else x for x in fps]
        df = spark.createDataFrame([(x,) for x in signed], "fp long")
        want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % (1 << 64)).count("1") <= radius}
        for crowd in (3, 100):
            got = [tuple(r) for r in links(df, radius, crowd).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_long_text():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert fingerprint(text) == plain_fingerprint(text)
