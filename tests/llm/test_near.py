"""Near copies and benchmark passages against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from strandline.llm import components, decontam, near, simhash
from strandline.llm.queries import QUERIES


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for sign in "\t\n\v\f\r":
        words = words.replace(sign, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                parent[find(a)] = find(b)
    least = {}
    for k in range(len(ids)):
        least[find(k)] = min(ids[k], least.get(find(k), ids[k]))
    return [least[find(k)] for k in range(len(ids))]


def test_fingerprints():
    rng = random.Random(1)
    for text in ["", " \t", "One", "One two", "a b c d e f", "É À é b", "x\x0by\x0cz w", *(" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 60))) for _ in range(50))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_query_op10(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_fingerprint(d.text or "") for d in docs]
    want = {d.doc_id: (f"{p:016x}", c) for d, p, c in zip(docs, prints, plain_components([d.doc_id for d in docs], prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash_pivots"](spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("chunk", [64, 4])
def test_links_of_a_dense_group(spark, monkeypatch, chunk):
    """Chains of few bits around one fingerprint, dealt to small chunks: components as by all pairs."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    prints = {0, *(int(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 9)).astype(np.uint64))) for _ in range(500))}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64)
    links = simhash.links(spark.createDataFrame([(int(x),) for x in signed], "fp long"))
    roots = {r.node: r.root for r in components.components(links).collect()}
    got = [roots.get(int(x), int(x)) for x in signed]
    want = plain_components([int(x) for x in signed], prints)
    assert got == want
    assert links.count() < 40 * len(prints)
    rows = simhash.dealt(spark.createDataFrame([(int(x),) for x in signed], "fp long"))
    assert (rows.filter("cell > 0").count() > 0) == (chunk == 4)  # groups that are hot twice over


def test_rows_of_a_hot_group(spark):
    """20,000 prints that share half of their bits: rows in proportion to them, and the planted chains linked."""
    rng = np.random.default_rng(3)
    mask = simhash.MASKS[7]
    prints = {int(x & ~mask) for x in rng.integers(0, 2**64, 20_000, np.uint64)}
    chains = []
    for x in sorted(prints)[:50]:
        chains.append([x])
        for _ in range(3):
            flips = int(np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, simhash.RADIUS, replace=False).astype(np.uint64)))
            chains[-1].append(chains[-1][-1] ^ flips)
    prints |= {x for c in chains for x in c}
    frame = spark.createDataFrame([(int(x),) for x in np.array(sorted(prints), np.uint64).view(np.int64)], "fp long")
    assert simhash.dealt(frame).count() < 30 * len(prints)
    roots = {r.node: r.root for r in components.components(simhash.links(frame)).collect()}
    for chain in chains:
        assert len({roots[int(x)] for x in np.array(chain, np.uint64).view(np.int64)}) == 1


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 160)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    empty = [r for r in rows if r.doc_id in (2, 3, 5)]
    assert {(r.fingerprint, r.component_id) for r in empty} == {("0" * 16, 2)}
    kept = simhash.survivors(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 4, 6, None]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.survivors(no_docs).count() == 0


def planted(spark, sf_dir):
    rng = random.Random(3)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for k in range(60):
        words = items[k % len(items)][1].split()
        cut = rng.randint(0, len(words) // 8)
        words = words[cut:] if rng.random() < 0.5 else words[: len(words) - cut]
        own = texts[k].split()
        at = rng.randint(0, len(own))
        texts[k] = " ".join([*own[:at], *words, *own[at:]])
    return texts, [*items, (900, "only three words"), (901, None), (902, " ... ")]


def plain_hits(texts, items):
    """(text number, item id): first word, words and similarity of the best of all windows, by all texts and items."""
    words = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    want = {}
    for item, text in items:
        own = re.findall(r"[^\W_]+", (text or "").lower())
        if not own:
            continue
        width = min(decontam.SHINGLE, len(own))
        counts = Counter(tuple(own[k : k + width]) for k in range(len(own) - width + 1))
        for n, doc in enumerate(words):
            m = min(len(own), len(doc))
            for w in range(len(doc) - m + 1 if m >= width else 0):
                shared = sum((Counter(tuple(doc[k : k + width]) for k in range(w, w + m - width + 1)) & counts).values())
                similarity = shared / (m + len(own) - 2 * width + 2 - shared)
                if similarity >= decontam.SIMILARITY and similarity > want.get((n, item), (0, 0, 0))[2]:
                    want[n, item] = w, m, similarity
    return want


@pytest.mark.parametrize("limits", [{}, {"CHUNK_SHINGLES": 100, "MOST_BITS": 1 << 10, "SPAN_AT_ONCE": 30, "CHARS_AT_ONCE": 2000}])
def test_hits_against_all_windows(spark, sf_dir, monkeypatch, limits):
    """Also in small chunks, and with a filter so full that it knows nearly everything."""
    for name, value in limits.items():
        monkeypatch.setattr(decontam, name, value)
    texts, items = planted(spark, sf_dir)
    texts += ["Only THREE, words!", "x only three words y", "", "only three"]
    texts[-4] += " ".join(t for _, t in items if t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    rows = decontam.contaminated(docs, benchmark).collect()
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.similarity) for r in rows}
    assert len(got) == len(rows) and got == plain_hits(texts, items)
    assert {r.doc_id for r in decontam.clean_rows(docs, benchmark).collect()} == set(range(len(texts))) - {n for n, _ in got}


def test_many_items_share_words(spark):
    """5,000 items that have most shingles in common with others; each document holds one or two of them, some edited."""
    rng = random.Random(8)
    items = [(k, f"the following question number {k} of this set asks for {k % 7} and {k % 11} of them, so answer with {k * 31 % 997} and say why it is so") for k in range(5000)]
    docs = []
    for d in range(40):
        one = items[rng.randrange(5000)][1].split()
        if d % 2:
            one[rng.randrange(len(one))] = "changed"
        docs.append((d, " ".join(["before", *one, "after"] * (1 + d % 3 // 2))))
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.similarity) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    some = [x for x in items if any(n in got for n in ((d, x[0]) for d, _ in docs))] + items[:60]
    assert len(got) >= 20 and {k: v for k, v in got.items()} == {k: v for k, v in plain_hits([t for _, t in docs], {x[0]: x for x in some}.values()).items()}


def test_contaminated_odd_rows(spark, odd_docs, no_docs):
    benchmark = spark.createDataFrame([(k, f"item number {k} has these words and then {k * 7} more of them") for k in range(9)] + [(50, None), (51, "")], "item_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(70, "before ITEM number 3 has these words, and then 21 more of them after"), (71, "item number 3 has other words")], "doc_id long, text string"))
    whole = {(r.doc_id, r.item_id, r.first_word) for r in decontam.contaminated(docs, benchmark).collect()}
    assert whole == {(70, 3, 1)}
    assert decontam.contaminated(no_docs, benchmark).count() == 0
    assert decontam.contaminated(docs, benchmark.limit(0)).count() == 0
    kept = decontam.clean_rows(docs, benchmark)
    assert kept.count() == docs.count() - 1 and kept.columns == docs.columns


def plain_survivors(ids, texts):
    """Smallest ids of the components of pairs with a five-word Jaccard similarity of 0.8 or more, by all pairs."""
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    return sorted(min(i for i, r in zip(ids, root) if r == one) for one in set(root))


def test_survivors_against_all_pairs(spark, monkeypatch):
    """Edited copies at all similarities around 0.8, most of them more than three bits apart; also in small chunks."""
    rng = random.Random(5)
    texts = []
    for k in range(25):
        base = [f"w{rng.randint(0, 999)}" for _ in range(rng.choice([9, 30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(9):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 30)):
                own[rng.randrange(len(own))] = f"v{rng.randint(0, 999)}"
            texts.append(" ".join(own))
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    want = plain_survivors(ids, texts)
    prints = [simhash.fingerprint(t) for t in texts]
    assert len(set(plain_components(ids, prints))) > len(want) + 20
    assert sorted(r.doc_id for r in simhash.survivors(docs).collect()) == want
    monkeypatch.setattr(near, "CHUNK", 3)
    assert sorted(r.doc_id for r in simhash.survivors(docs).collect()) == want


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """The near-dedup stage links by op10's fingerprints, also with no min-hash in common; an exact check follows."""
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    base = words(3000)
    texts = [" ".join(base), " ".join([*base[:1500], "other", *base[1501:]]), " ".join(base[:2999]), *(" ".join(words(200)) for _ in range(5)), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [near.shingles(t) for t in texts[:3]]
    assert all((simhash.majority(s) ^ simhash.majority(sets[0])).bit_count() <= simhash.RADIUS for s in sets)
    monkeypatch.setattr(near, "BANDS", 0)
    monkeypatch.setattr(near, "bands", lambda hashes: np.zeros(0, np.uint64))
    assert sorted(r.doc_id for r in simhash.survivors(docs).collect()) == [0, 3, 4, 5, 6, 7, 8]
