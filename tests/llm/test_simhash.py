import numpy as np
import pytest
import xxhash
from pyspark.sql import Row, functions as F

from tidemark.llm import simhash
from tidemark.llm.components import components
from tidemark.workspace import Workspace

SCHEMA = "doc_id bigint, text string"


def plain_fingerprint(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = [b" ".join(words[i : i + width]) for i in range(n)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > n)


def plain_components(fps, limit):
    """Smallest index reachable, for a list of fingerprints."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= limit and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


@pytest.mark.parametrize("text", [None, "", "  \n", "one", "One TWO", "a b c d e f g a b c", "É é Ünï\tcode\x0bwords x y z"])
@pytest.mark.parametrize("width", [3, 5])
def test_fingerprint(text, width):
    assert simhash.fingerprint(text, width) == plain_fingerprint(text, width)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i * i % 997}" for i in range(3000))
    whole = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text, 3) == whole == plain_fingerprint(text, 3)


@pytest.mark.parametrize("chunk", [4, 512])
def test_links_lose_nothing(spark, monkeypatch, chunk):
    """Random fingerprints, chains of near ones and one dense group, against all pairs."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(25):
        fp = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(6):
            fps.add(fp)
            for bit in rng.integers(0, 64, rng.integers(1, 5)):
                fp ^= 1 << int(bit)
    centre = int(rng.integers(0, 1 << 63))
    fps |= {centre ^ (1 << a) ^ (1 << b) for a, b in rng.integers(0, 64, (60, 2)).tolist()}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint").repartition(3)
    space = Workspace(spark)
    roots = {r.node: r.root for r in components(simhash.links(df, 3, space), space).collect()}
    label = plain_components([f & (1 << 64) - 1 for f in fps], 3)
    assert [roots.get(f, f) for f in fps] == [fps[i] for i in label]
    space.release()


def test_components_of_odd_graphs(spark):
    space = Workspace(spark)
    path = [(i, i + 1) for i in range(40)]
    star = [(1000 + i, 1000) for i in range(1, 50)]
    edges = path + star + [(1, 0), (1000, 1000), (5, 5), (7, 6)]
    found = dict(components(spark.createDataFrame(edges, "a bigint, b bigint"), space).collect())
    assert found == {**{i: 0 for i in range(1, 41)}, **{1000 + i: 1000 for i in range(1, 50)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), space).collect() == []
    space.release()


def test_classes_and_representatives(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [
        Row(doc_id=7, text=base, fp="x", key=1), Row(doc_id=3, text=base + " tail", fp="y", key=2),
        Row(doc_id=3, text=base + " tail", fp="y", key=2), Row(doc_id=9, text=None, fp=None, key=None),
        Row(doc_id=8, text="", fp="", key=0), Row(doc_id=11, text="quite another text altogether", fp="z", key=3),
        Row(doc_id=None, text=base, fp="n", key=4),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, key int")
    space = Workspace(spark)
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, space).collect()}
    assert found == {(7, 3), (3, 3), (9, 8), (8, 8), (11, 11), (None, 3)}
    kept = simhash.representatives(docs, space)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.fp) for r in kept.collect()) == [("11", "z"), ("3", "y"), ("8", ""), ("None", "n")]
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty, space).count() == 0 and simhash.representatives(empty, space).count() == 0
    space.release()


def test_similar_documents(spark):
    """Against all pairs: near copies are linked, texts on one template whose fingerprints chain are not."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    base = words(300)
    texts = [" ".join(base[:240] + words(90)) for _ in range(120)]  # pairwise about 0.55
    texts += [" ".join(base[:270] + words(45)) for _ in range(120)]  # about 0.7, within six bits now and then
    for n in range(8):
        near = words(200)
        for _ in range(6):
            near = near[:]
            near[int(rng.integers(0, 200))] = f"other{n}"
            texts.append(" ".join(near))
    texts += [texts[0], "", None]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    fps = [plain_fingerprint(t, 5) for t in texts]
    label, chained = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 6:
                if simhash.jaccard(sets[i], sets[j]) < 0.8:
                    chained += 1
                elif label[i] != label[j]:
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if x == old else x for x in label]
    assert chained > 20
    space = Workspace(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs, space, 5, 6, 0.8).collect()}
    assert [found[i] for i in range(len(texts))] == label
    kept = {r.doc_id for r in simhash.representatives(docs, space, 5, 6, 0.8).collect()}
    assert kept == set(label)
    assert simhash.representatives(docs.limit(0), space, 5, 6, 0.8).count() == 0
    space.release()


def test_alike_sets():
    """Against one pair at a time, with more columns than one block holds and with empty sets."""
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 6000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (1, 5, 3000, 6000, 9000, 9000)] + [np.zeros(0, np.uint64)] * 2
    sets += [s[: max(1, len(s) * 9 // 10)] for s in sets[:6]]
    for least in (0.1, 0.8):
        found = simhash.alike_sets(sets[:9], sets[4:], least)
        assert found.tolist() == [[simhash.jaccard(a, b) >= least for b in sets[4:]] for a in sets[:9]]


def test_band_hashes():
    """Pairs at 0.8 share a band nearly always, unlike ones hardly ever; a set's order and blocks do not matter."""
    rng = np.random.default_rng(6)
    shared = {0.8: 0, 0.3: 0}
    for least in shared:
        for _ in range(200):
            hashes = rng.integers(0, 1 << 63, 1800).astype(np.uint64)
            both = int(1800 * least)
            middle = both + (1800 - both) // 2
            one, other = hashes[:middle], np.concatenate((hashes[:both], hashes[middle:]))
            shared[least] += bool(set(simhash.band_hashes(one)) & set(simhash.band_hashes(other)))
    assert shared[0.8] >= 185 and shared[0.3] <= 10
    assert simhash.band_hashes(hashes) == simhash.band_hashes(hashes[::-1]) and len(simhash.band_hashes(hashes)) == simhash.BANDS
    assert simhash.band_hashes(hashes[:0]) == []


@pytest.mark.parametrize("chunk", [4, 512])
def test_similar_documents_whatever_their_fingerprints(spark, monkeypatch, chunk):
    """All pairs of 0.8 and more are linked, also those whose fingerprints differ in many bits, and no others."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(9)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    base, texts = words(300), []
    texts += [" ".join(base[:270] + words(45)) for _ in range(60)]  # pairwise about 0.73
    texts += [" ".join(base[:290] + words(12)) for _ in range(20)]  # about 0.9
    for _ in range(40):
        near = words(200)
        texts += [" ".join(near), " ".join(near[:-8] + words(8)), " ".join(near[9:] + words(9))]  # 0.92, 0.91, 0.84
    texts += ["", None, " \n", "one", "ONE", "a b c d", texts[3]]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    label = list(range(len(texts)))
    far = 0
    for i in range(len(texts)):
        for j in range(i):
            if simhash.jaccard(sets[i], sets[j]) >= 0.8 and label[i] != label[j]:
                far += bin(plain_fingerprint(texts[i], 5) ^ plain_fingerprint(texts[j], 5)).count("1") > 3
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert far > 20
    space = Workspace(spark)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, band string").repartition(5)
    found = {r.doc_id: r.component_id for r in simhash.all_similar_documents(docs, space, 5, 3, 0.8).collect()}
    assert [found[i] for i in range(len(texts))] == label
    odd = docs.filter("doc_id < 5").withColumn("doc_id", F.lit(None).cast("bigint")).unionByName(docs.filter("doc_id = 7")).unionByName(docs.filter("doc_id = 7"))
    kept = simhash.representatives(odd, space, 5, 3, 0.8, bands=True)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["7"] + ["None"] * 5
    assert simhash.all_similar_documents(docs.limit(0), space, 5, 3, 0.8).count() == 0
    space.release()


def test_last_components_start_from_stars(spark, monkeypatch):
    """The last search for components is given the stars of the verified pairs, not the pairs again; classes as before."""
    calls = []

    def recorded(edges, space):
        found = components(edges, space)
        calls.append((edges.count(), found.count()))
        return found

    monkeypatch.setattr(simhash, "components", recorded)
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    base, texts = words(300), []
    texts += [" ".join(base[:290] + words(12)) for _ in range(20)]  # pairwise about 0.9
    for _ in range(10):
        near = words(200)
        texts += [" ".join(near), " ".join(near[:-8] + words(8)), " ".join(near[9:] + words(9))]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if simhash.jaccard(sets[i], sets[j]) >= 0.8 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    space = Workspace(spark)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in simhash.all_similar_documents(docs, space, 5, 3, 0.8).collect()}
    assert [found[i] for i in range(len(texts))] == label
    (_, stars), (last, _) = calls[-2], calls[-1]
    # No links beyond the stars join parts here, so the last search gets exactly the stars.
    assert last == stars == len(texts) - len(set(label))
    space.release()
