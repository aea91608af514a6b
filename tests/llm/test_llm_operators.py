"""The training-data operators on small tables with the awkward rows, against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

pytest.importorskip("cuewright.llm.queries")

from cuewright.llm import common, components, decontamination, hashing, packing, quality, search, sharding, simhash, token_store, tokens, toxicity, url_rules, warc

DOCS = "doc_id long, text string, lang string, score double, fp string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.5, "x") for i, t in rows], DOCS)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Epsilon,", "zeta.", "eta!", "theta"]) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(5)
    base = [words(rng, rng.randint(1, 300)) for _ in range(30)]
    rows = list(enumerate(base))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "x" * 5000), (104, words(rng, 9000)), (None, base[0]), (None, None), (7, base[7]), (7, base[8]), (105, base[3]), (106, base[3] + " more")]
    return rows


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, tokens.END], "<u4") for x in texts]


def test_encoder_equals_the_library():
    rng = random.Random(3)
    bits = ["a", " ", "  ", "\n", "\t", "é", "!", ".", "9", "\xa0", "<|endoftext|>", " \n", "the", "\r\n", "日本", "'s", "\u200b", "😀", "_", "x" * 70 + "! ", "Ü!!", "…..", "é.×..."]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(4000)] + [None]
    for t, ids, want in zip(texts, tokens.encoder(tokens.vocabulary_path()).documents(texts), reference_ids(texts), strict=True):
        assert ids.tolist() == want.tolist(), repr(t)


def test_hashes_do_not_depend_on_batches():
    rng = random.Random(1)
    texts = [words(rng, rng.randint(0, 50)) for _ in range(50)] + [None, "", "y" * (2 * hashing.SLICE + 5) + " z"]
    whole = {f + int(d): [] for f, c, *_ in hashing.batches(texts, True) for d in range(c)}
    for first, _, doc, h, *_ in hashing.batches(texts, True):
        for d, x in zip(doc.tolist(), h.tolist(), strict=True):
            whole[first + d].append(x)
    for i, t in enumerate(texts):
        assert [x for _, _, _, h, *_ in hashing.batches([t], True) for x in h.tolist()] == whole[i]


def test_long_tokens_that_swap_bytes_differ():
    a, b = "a" * 64 + "b" * 64, "b" * 64 + "a" * 64
    (_, _, _, h, *_), = hashing.batches([f"{a} {b} {a}b {b}a {'ab' * 64} {'a' * 65} {'a' * 66}"], True)
    assert len(set(h.tolist())) == 7


def test_token_store_round_trip(spark, awkward, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs(spark, awkward), path)
    got = token_store.read_index(spark, path).collect()
    assert token_store.verify(spark, path) and len(got) == len(awkward)
    want = collections.Counter((i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(awkward, reference_ids([t for _, t in awkward]), strict=True))
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    rebuilt = collections.Counter((r.doc_id, tuple(r.ids)) for r in token_store.read_documents(spark, path).collect())
    assert rebuilt == collections.Counter((i, tuple(x.tolist())) for (i, _), x in zip(awkward, reference_ids([t for _, t in awkward]), strict=True))
    names = spark.read.parquet(f"{path}/chunks").where("payload is not null")
    assert names.count() == names.select("chunk_id").distinct().count()


def test_token_store_detects_damage(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs(spark, [(1, "some words here"), (2, "other words there")]), path)
    chunks = spark.read.parquet(f"{path}/chunks").selectExpr("chunk_id", "n", "cast(reverse(payload) as binary) payload", "row", "k", "doc_id").collect()
    schema = "chunk_id binary, n int, payload binary, row long, k int, doc_id long"
    spark.createDataFrame(chunks, schema).write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="match its name"):
        token_store.read_index(spark, path).collect()


def test_crc_combination():
    a, b = random.Random(1).randbytes(999), random.Random(2).randbytes(13_000)
    assert token_store.combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_packing(spark, awkward):
    got = packing.pack(docs(spark, awkward)).collect()
    want = collections.Counter()
    for (i, _), ids in zip(awkward, reference_ids([t for _, t in awkward]), strict=True):
        for k, (s, n) in enumerate(packing.cut(len(ids), packing.CAPACITY)):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


@pytest.mark.parametrize("ranges", [9, 1_000])
def test_supersteps_fill_as_the_row_by_row_loop(spark, monkeypatch, ranges):
    monkeypatch.setattr(packing, "RANGE_ROWS", ranges)
    rng = random.Random(ranges)
    for capacity, n, top in ((64, 150, 64), (64, 40, 3), (10, 60, 10), (64, 60, 24)):
        lengths = [min(top, rng.choice([rng.randint(1, top), rng.randint(1, 8), top])) for _ in range(n)]
        rows = spark.createDataFrame(list(enumerate(lengths)), "pid long, length int")
        got = collections.defaultdict(list)
        for r in packing.place(rows, capacity).collect():
            got[r.sequence_id].append((r.offset, r.pid))
        assert sorted(i for x in got.values() for _, i in x) == list(range(n))
        ends = []
        for s, some in got.items():
            at = 0
            for offset, i in sorted(some):
                assert offset == at, s
                at += lengths[i]
            assert at <= capacity
            ends.append(capacity - at)
        # best-fit decreasing, one piece at a time
        room = []
        for x in sorted(lengths, reverse=True):
            fit = min((g for g in room if g >= x), default=None)
            if fit is None:
                room.append(capacity - x)
            else:
                room[room.index(fit)] -= x
        if ranges == 1_000:
            assert sorted(ends) == sorted(room)
        assert len(got) <= len(room) + 2, (capacity, n, top)


def test_no_pieces_no_sequences(spark):
    assert packing.pack(docs(spark, [])).collect() == []


def brute_components(values, near):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def brute_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, awkward):
    rows = [r for r in awkward if r[0] is not None]
    got = simhash.near_duplicates(docs(spark, awkward)).collect()
    fps = [brute_fingerprint(t) for _, t in awkward]
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = collections.defaultdict(list)
    for (i, _), r in zip(awkward, roots, strict=True):
        if i is not None:
            least[r].append(i)
    want = collections.Counter((i, f"{f:016x}", min(least[r], default=None)) for (i, _), f, r in zip(awkward, fps, roots, strict=True))
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.keep_one(docs(spark, awkward))
    assert kept.columns == docs(spark, awkward).columns
    assert kept.count() == len(set(roots)) and len(rows) < len(awkward)


@pytest.mark.parametrize("bucket", [2, 40, 4096])
def test_crowded_buckets_lose_no_link(spark, bucket):
    rng = random.Random(bucket)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), bucket)
    roots = {r.node: r.root for r in components.components(links).collect()}
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    mine = [roots.get(x[0], x[0]) for x in signed]
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_chain_condition_holds_for_all_near_pairs():
    rng = random.Random(8)
    d = np.array([sum(1 << b for b in rng.sample(range(64), k)) for k in (0, 1, 2, 3) for _ in range(2000)], np.uint64)
    assert simhash.chain_ok(d).all()


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        row, old = [i], row
        for j, y in enumerate(t, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1))
    return min(row)


def test_myers_distance():
    rng = random.Random(2)
    for _ in range(300):
        p, t = ([rng.randint(0, 3) for _ in range(rng.randint(1, n))] for n in (80, 120))
        assert decontamination.myers(np.array(p), np.array(t))[0] == min(len(p), brute_distance(p, t))


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, words(rng, rng.randint(6, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "too short"), (1, "same id other text of some words")]
    rows = []
    for i in range(60):
        text = words(rng, 80).split()
        w = items[i % 12][1].split()
        for _ in range(i % 6):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["edit"], ["two", "edits"]])
        rows.append((i, " ".join(text[:40] + w + text[40:])))
    rows += [(100, None), (101, ""), (None, items[0][1]), (7, rows[7][1]), (102, " ".join(w for _, w in items[:12]))]
    clean = lambda t: "".join(c if c.isalnum() or c == "_" else " " for c in (t or "").lower()).split()
    want = collections.Counter()
    for i, t in rows:
        for k, x in items:
            p = clean(x)
            if len(p) >= 5:
                d = brute_distance(p, clean(t))
                if d <= int(0.2 * len(p)):
                    want[i, k, d] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (4 << 20, 200):
        got = decontamination.contaminated(docs(spark, rows), bench, decontamination.MatchParams(block_bytes=block)).collect()
        assert collections.Counter((r.doc_id, r.item_id, r.distance) for r in got) == want
    kept = decontamination.clean(docs(spark, rows), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if not any(k[0] == i for k in want))
    assert decontamination.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def test_sharding_table():
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill(names, 101)
    # the rule once more, turn by turn
    import hashlib

    order = []
    for s in names:
        h = hashlib.blake2b(s.encode(), digest_size=16).digest()
        a, b = int.from_bytes(h[:8], "big") % 101, int.from_bytes(h[8:], "big") % 100 + 1
        order.append([(a + j * b) % 101 for j in range(101)])
    want, turn = {}, 0
    while len(want) < 101:
        slot = next(x for x in order[turn % 7] if x not in want)
        want[slot] = turn % 7
        turn += 1
    assert table == [want[i] for i in range(101)]
    counts = collections.Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill(names[:-1], 101)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 30
    with pytest.raises(ValueError):
        sharding.fill(names, 100)


def test_sharding_places_every_row(spark, awkward):
    import hashlib

    d = docs(spark, awkward).withColumnRenamed("lang", "shard")
    got = sharding.place(d, ["a", "b", "c"], 101).collect()
    assert len(got) == len(awkward)
    table = sharding.fill(["a", "b", "c"], 101)
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, "abc"[table[slot]])


def test_url_host_path_and_rules(spark):
    from cuewright.llm.queries import RULES

    urls = [
        ("https://WWW.Example.ORG/es/x?q#f", "www.example.org", "/es/x", "example.org/es/", "block"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://a.org", "a.org", "", None, "allow"), ("http://a.org/", "a.org", "/", "org/", "allow"), ("http://b.com/fr/1", "b.com", "/fr/1", "com/fr/", "allow"),
        ("http://b.com/de/#x", "b.com", "/de/", "com/de/", "block"), ("http://xcom/de/", "xcom", "/de/", None, "allow"), (None, "", "", None, "allow"), ("nothing", "", "", None, "allow"),
        ("", "", "", None, "allow"), ("x://", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("http://a.com?x=/de/", "a.com", "", None, "allow"),
        ("http://ÄB.org/é", "Äb.org", "/é", "org/", "allow"), ("http://a.org/", "a.org", "/", "org/", "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "h", 3) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.judge(pages, labels, RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), urls[i]


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        host, word = rng.choice(["spam", "news", "blog"]), rng.choice(["pills", "cars", "art"])
        rows.append((i, f"http://{host}.test/{word}/{i}", int(rng.random() < (0.9 if (host, word) == ("spam", "pills") else 0.1))))
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, _, b in rows], "doc_id long, quality int, toxic int")
    p = url_rules.MiningParams(support=0.02, confidence=0.5, lift=1.2)
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, labels, [], p).collect()}
    from itertools import combinations

    sets = {i: {"host=" + u[7:].split(".")[0], "host=test", "name=" + u[7:].split("/")[0], "path=" + u.split("/")[3], "path=#"} for i, u, _ in rows}
    base = sum(b for *_, b in rows) / len(rows)
    seen, bad = collections.Counter(), collections.Counter()
    for i, _, b in rows:
        for n in range(1, 6):
            for c in combinations(sorted(sets[i]), n):
                seen[c] += 1
                bad[c] += b
    rules = [set(c) for c in seen if bad[c] / len(rows) >= p.support and bad[c] / seen[c] >= p.confidence and bad[c] / seen[c] / base >= p.lift]
    assert rules and {i: "block" if any(r <= sets[i] for r in rules) else "allow" for i in sets} == got


def test_segments_against_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        x = [rng.choice([-2, -1, -1, 1, 2]) for _ in range(rng.randint(0, 25))]

        def best(lo, hi):
            """The first shortest interval of the largest positive sum, then the same on both sides."""
            top = max(((sum(x[a:b]), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
            if top[0] <= 0:
                return []
            a, b = -top[2], -top[2] - top[1]
            return best(lo, a) + [(a, b, top[0])] + best(b, hi)

        got = toxicity.segments(np.array(x, float))
        assert sorted(s for *_, s in got) == sorted(s for *_, s in best(0, len(x)))
        assert all(sum(x[a:b]) == s for a, b, s in got)


def toy(rng, bad):
    t = words(rng, rng.randint(5, 60)).split()
    if bad:
        for _ in range(4):
            t.insert(rng.randrange(len(t)), rng.choice(["vile", "nasty", "foul"]))
    return " ".join(t)


@pytest.mark.parametrize("kind", ["toxicity", "quality"])
def test_classifiers_learn_and_carry_every_row(spark, kind):
    rng = random.Random(11)
    rows = [(i, toy(rng, i % 4 == 0)) for i in range(600)]
    more = [(1000, None), (1001, ""), (None, "vile nasty foul"), (5, rows[5][1])]
    d = docs(spark, rows + more)
    y = lambda i: int(i % 4 == 0)
    labels = [(i, 1 - y(i), y(i)) for i, _ in rows] + [(4, 0, 1), (None, 1, 1), (9999, 1, 0), (6, None, None)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = (toxicity.toxicity if kind == "toxicity" else quality.quality)(d, labels).collect()
    assert len(got) == len(rows) + len(more)
    mod, rest = (4, 2) if kind == "toxicity" else (5, 0)
    right = n = 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % mod == rest)
        if r.held_out and r.doc_id is not None and r.doc_id < 600:
            n += 1
            want = y(r.doc_id) if kind == "toxicity" else 1 - y(r.doc_id)
            right += (r.predicted == want) if kind == "toxicity" else ((r.score >= 0.75) == want)
    assert right / n > 0.9, (right, n)
    run = toxicity.toxicity if kind == "toxicity" else quality.quality
    assert sorted(map(str, run(d, labels).collect())) == sorted(map(str, got))  # runs agree
    none = run(d, labels.limit(0)).collect()
    assert len(none) == len(rows) + len(more) and all(abs(r.score - 0.5) < 1e-6 for r in none)
    ones = run(d, labels.where("doc_id % 4 = 0").where("doc_id < 600")).collect()  # one class only
    n = len({i for i in range(0, 600, 4) if zlib.crc32(str(i).encode()) % mod != rest})
    share = (n + 1) / (n + 2) if kind == "toxicity" else 1 / (n + 2)
    assert all(abs(r.score - share) < 1e-6 for r in ones)
    assert (toxicity.toxicity if kind == "toxicity" else quality.quality)(d.limit(0), labels).count() == 0


def test_training_equals_plain_ftrl(spark):
    """The update rule, one feature at a time, on the operator's own features; shards in turn, then their mean."""
    rng = random.Random(21)
    p = quality.QualityParams(bits=8, shards=2, rounds=2)
    rows = [(i, toy(rng, i % 3 == 0)) for i in range(60)] + [(60, None), (61, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    got = quality.train(docs(spark, rows), labels, common.held_out("doc_id", 1, 0), "quality", p).weights
    shards = collections.defaultdict(list)
    for r in spark.createDataFrame([(i,) for i, _ in rows], "doc_id long").selectExpr("doc_id", f"pmod(xxhash64(doc_id), {p.shards}) s").collect():
        shards[r.s].append(r.doc_id)
    text = dict(rows)
    z, n = [0.0] * 257, [0.0] * 257
    for _ in range(p.rounds):
        ends = []
        for s in sorted(shards):
            zs, ns = ([float(np.float32(x)) for x in v] for v in (z, n))
            for i in sorted(shards[s]):
                x = collections.Counter({256: 1.0})
                for _, _, doc, h, flags, cap, _ in hashing.batches([text[i]], fold=False):
                    for kind in quality._features(h, flags, cap, doc, p.bits):
                        for b in kind.tolist():
                            x[b] += p.scale / len(h)
                w = {}
                for b in x:
                    w[b] = 0.0 if abs(zs[b]) <= p.l1 else -(zs[b] - math.copysign(p.l1, zs[b])) / ((p.beta + math.sqrt(ns[b])) / p.alpha + p.l2)
                guess = 1 / (1 + math.exp(-sum(w[b] * v for b, v in x.items())))
                for b, v in x.items():
                    g = (guess - int(i % 3 > 0)) * v
                    zs[b] += g - (math.sqrt(ns[b] + g * g) - math.sqrt(ns[b])) / p.alpha * w[b]
                    ns[b] += g * g
            ends.append((len(shards[s]) / len(rows), zs, ns))
        z, n = ([sum(share * float(np.float32(v[k][b])) for share, *v in ends) for b in range(257)] for k in (0, 1))
    want = [0.0 if abs(a) <= p.l1 else -(a - math.copysign(p.l1, a)) / ((p.beta + math.sqrt(c)) / p.alpha + p.l2) for a, c in zip(z, n, strict=True)]
    assert np.allclose(got, want, atol=1e-4)


def test_log_odds_and_chance_equal_plain_counts(spark):
    rng = random.Random(22)
    p = toxicity.ToxicityParams(bits=16)
    rows = [(i, toy(rng, i % 4 == 0) + " vile" * (i % 10 == 1)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    m = toxicity.train(docs(spark, rows), labels, common.held_out("doc_id", 1, 0), "toxic", p)
    seen = {k: collections.Counter() for k in ("w0", "w1", "s0", "s1")}
    texts, of = [], {}
    for i, t in rows:
        some = re.findall("[a-z0-9_]+", t.lower())
        texts.append((some, int(i % 4 == 0)))
        for x in some:
            seen[f"w{int(i % 4 == 0)}"][x] += 1
            seen[f"s{int(i % 4 == 0)}"][x[: p.stem_bytes]] += 1
            of[x] = x[: p.stem_bytes]
    c, t = sum(seen["w0"].values()), sum(seen["w1"].values())
    base = t / (c + t)
    logit = lambda q: math.log(q / (1 - q))
    score = {}
    for x, stem in of.items():
        prior = (seen["s1"][stem] + p.prior * base) / (seen["s0"][stem] + seen["s1"][stem] + p.prior)
        share = (seen["w1"][x] + p.prior * prior) / (seen["w0"][x] + seen["w1"][x] + p.prior)
        score[x] = min(logit(share) - logit(base) - p.drift, p.cap)
    for x in ("vile", "nasty", "foul", *list(of)[:20]):
        (_, _, _, word, _), = toxicity._words([x], p)
        assert abs(m.word[word[0]] - score[x]) < 2e-3, x
    mean = lambda lam: sum(n * math.exp(lam * score[x]) for x, n in seen["w0"].items()) / c
    assert abs(mean(m.lam) - 1) < 0.05
    segments = sum(x >= p.drift for some, y in texts if not y for *_, x in toxicity.segments(np.array([score[w] for w in some])))
    assert abs(m.k - max(segments, 1) * math.exp(m.lam * p.drift) / c) < 0.05 * m.k
    found = {r.doc_id: r.passages for r in toxicity.toxic_passages(docs(spark, [*rows, (900, None), (901, "vile nasty foul vile nasty foul")]), m, p).collect()}
    assert 901 in found and 900 not in found and found[901][0].first_word == 0 and found[901][0].end_word == 6


def test_shards_are_written_whole(spark, awkward, tmp_path):
    d = docs(spark, awkward).select("doc_id", "text")
    sharding.write_shards(d, f"file://{tmp_path}/shards", ["a", "b", "c"], 101, parts=2)
    got = spark.read.parquet(f"file://{tmp_path}/shards")
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter(awkward)


def test_mined_rules_fit_held_out_urls(spark):
    """Rules of one half of the labelled URLs block more bad than good ones of the other half; noise gives no rules."""
    rng = random.Random(5)
    rows = []
    for i in range(2000):
        host, word = rng.choice(["spam", "news", "blog"]), rng.choice(["pills", "cars", "art"])
        rows.append((i, f"http://{host}.test/{word}/{i}", int(rng.random() < (0.9 if (host, word) == ("spam", "pills") else 0.1))))
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    half = spark.createDataFrame([(i, 1 - b, 0) for i, _, b in rows if i % 2], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, half, []).collect()}
    bad = [got[i] for i, _, b in rows if not i % 2 and b]
    good = [got[i] for i, _, b in rows if not i % 2 and not b]
    assert bad.count("block") > 0.4 * len(bad) and good.count("block") < 0.05 * len(good)
    noise = spark.createDataFrame([(i, int(rng.random() > 0.3), 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    assert {r.verdict for r in url_rules.judge(pages, noise, []).collect()} == {"allow"}


def test_match_starts_where_the_edits_say(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"x y {item} z"), (2, "x y one two three extra four five six seven eight nine ten z"), (3, "x y one two four five six seven eight nine ten z")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.distance, r.start_word, r.end_word) for r in decontamination.contaminated(docs(spark, rows), bench).collect()}
    assert got == {1: (0, 2, 12), 2: (1, 2, 13), 3: (1, 2, 11)}


def test_search_against_brute_force(spark, awkward):
    rng = random.Random(12)
    rows = awkward + [(200 + i, words(rng, rng.randint(1, 60))) for i in range(150)]
    d = docs(spark, rows)
    queries = spark.createDataFrame([(i, t) for i, t in rows if i is not None and i % 5 == 0], "query_id long, text string")
    p = search.SearchParams(k=4, buffer_docs=50, shard_docs=20, common=4, batch=3, block_terms=400, passes=(1, 3))
    got = collections.defaultdict(list)
    for r in search.top_k(d, queries, p).collect():
        got[r.query_id].append((r["rank"], r.doc_id, r.score))
    words_in = lambda t: collections.Counter(w for w in re.findall("[a-z0-9_\x80-\U0010ffff]+", (t or "").lower()) if w.strip("_"))
    vec = [(i, words_in(t)) for i, t in rows if i is not None]
    n, mean = len(vec), sum(sum(c.values()) for _, c in vec) / len(vec)
    df = collections.Counter(x for _, c in vec for x in c)
    for q, t in rows:
        if q is None or q % 5:
            continue
        qv = words_in(t)
        scored = []
        for i, c in vec:
            size = sum(c.values())
            s = sum(f * float(np.float32(math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * size / mean)))) for x, f in qv.items() if x in c)
            if s > 0:
                scored.append((-round(s, 6), i))
        want = sorted(scored)[:4]
        assert [(r, i) for r, i, _ in sorted(got[q])] == [(k + 1, i) for k, (_, i) in enumerate(want)], q
        assert np.allclose([s for *_, s in sorted(got[q])], [-s for s, _ in want], atol=2e-6)


def test_warc_resolution(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "http://A.com/x", 10, 200, h(etag='"a"', content_type="html", date="1"), "d1"), (2, "https://www.a.com/x/#f", 20, 304, h(etag='W/"a"', date="2", content_type="evil"), None),
        (3, "http://a.com/x?utm_source=1", 30, 304, h(etag='"b"'), None), (4, "http://a.com/x", 5, 304, h(), None), (5, "http://a.com/x", 40, 304, None, None),
        (6, "http://a.com/x", 40, 200, h(last_modified="m"), "d6"), (7, "http://a.com/x", 40, 304, h(last_modified="m", age="3"), None), (8, None, 50, 304, h(), None),
        (9, None, 45, 200, h(), "d9"), (10, "http://a.com/y", 50, 404, h(), "d"), (None, "http://a.com/x", 60, 304, h(last_modified="n"), "own"),
    ]
    r = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>, digest string")
    got = {x.record_id: x for x in warc.resolve(r).collect()}
    assert {k: (v.outcome, v.source_id, v.digest) for k, v in got.items()} == {
        2: ("resolved", 1, "d1"), 3: ("validator_mismatch", None, None), 4: ("no_earlier_response", None, None), 5: ("no_validator", 1, "d1"),
        7: ("resolved", 6, "d6"), 8: ("no_earlier_response", None, None), None: ("validator_mismatch", None, "own"),
    }
    assert got[2].headers == {"etag": 'W/"a"', "content-type": "html", "date": "2"}
    assert got[7].headers == {"last-modified": "m"}
    assert warc.resolve(r.limit(0)).count() == 0


def test_warc_carries_between_blocks(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h/{rng.choice('aab')}", rng.randint(0, 500), rng.choice([200, 304, 304]), {}, str(i)) for i in range(1500)]
    r = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>, digest string")
    want = {}
    last = {}
    for i, u, t, s, _, _ in sorted(rows, key=lambda x: (x[2], x[0])):
        if s == 200:
            last[u] = i
        else:
            want[i] = last.get(u)
    assert {x.record_id: x.source_id for x in warc.resolve(r).collect()} == want


@pytest.mark.parametrize("per_task", [30, 10_000])
def test_components_against_brute_force(spark, per_task):
    rng = random.Random(7)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1080)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long"), per_task=per_task).collect()}
    root = {}
    for a, b in pairs:
        for x in (a, b):
            root.setdefault(x, x)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    linked = {x for p in pairs if None not in p and p[0] != p[1] for x in p}
    assert got == {x: find(x) for x in linked}


def test_shared_dir_is_the_sessions(spark):
    found = spark.conf.get("spark.checkpoint.dir", None)
    assert common.shared_dir(spark) == found.rstrip("/") if found else common.shared_dir(spark).startswith("file://")


def test_segment_scan_is_linear_whichever_way_the_sums_drift():
    import time

    rng = np.random.default_rng(4)

    def seconds(x):
        best = math.inf
        for _ in range(3):
            began = time.perf_counter()
            toxicity.segments(x)
            best = min(best, time.perf_counter() - began)
        return best

    n = 200_000
    for one in (lambda m: np.tile([1.0, -2.0], m // 2), lambda m: np.tile([2.0, -1.0], m // 2), lambda m: rng.normal(0, 1, m), lambda m: rng.normal(-0.3, 1, m)):
        assert seconds(one(2 * n)) <= 2.5 * seconds(one(n)) + 0.05


def test_url_rules_of_noise_are_dropped_and_small_true_ones_kept(spark):
    rng = random.Random(11)
    rows = [(i, f"http://h{rng.randint(0, 30)}.test/w{rng.randint(0, 40)}/{i}", int(rng.random() < 0.26)) for i in range(600)]
    labels = lambda found: spark.createDataFrame([(i, 1 - b, 0) for i, _, b in found], "doc_id long, quality int, toxic int")
    pages = lambda found: spark.createDataFrame([(i, u) for i, u, _ in found], "page_id long, url string")
    assert {r.verdict for r in url_rules.judge(pages(rows), labels(rows), []).collect()} == {"allow"}
    planted = rows + [(1000 + i, f"http://h{i % 30}.test/pills/{i}", 1) for i in range(12)]
    blocked = {r.page_id for r in url_rules.judge(pages(planted), labels(planted), []).where("verdict = 'block'").collect()}
    assert blocked == {1000 + i for i in range(12)}


def test_url_rule_bound_is_above_the_binomial_tail(spark):
    cases = [(k, n) for n in (1, 5, 12, 40) for k in range(n + 1)]
    df = spark.createDataFrame([(k / n, float(n)) for k, n in cases], "share double, n double")
    got = [r[0] for r in df.select(url_rules.ln_tail(df["share"], df["n"], 0.26)).collect()]
    for (k, n), x in zip(cases, got, strict=True):
        tail = sum(math.comb(n, i) * 0.26**i * 0.74 ** (n - i) for i in range(k, n + 1))
        assert math.log(tail) <= x + 1e-9
        if k == n:
            assert x == pytest.approx(n * math.log(0.26))


def test_sharding_replaces_columns_of_any_case(spark):
    docs = spark.createDataFrame([(1, 5, "mine"), (None, 6, "too"), (1, 5, "mine")], "doc_id long, Slot int, SHARD string")
    out = sharding.place(docs, ["a", "b"], 101)
    assert out.columns == ["doc_id", "slot", "shard"] and out.count() == 3
    assert {(r.doc_id, r.slot) for r in out.collect()} == {(r.doc_id, r.s) for r in docs.select("doc_id", sharding.slot_of(docs["doc_id"], 101).alias("s")).collect()}


def test_shards_are_written_without_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    sharding.write_shards(docs, str(tmp_path / "shards"), ["a", "b"], 101, parts=3)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 50


def test_one_sided_validators_take_nothing(spark):
    tag, day = {"etag": '"x"'}, {"last-modified": "day 1"}
    cases = [({}, {}), ({}, tag), (tag, {}), (tag, day), (day, tag), (day, {}), (tag | day, day), (tag, tag | day)]
    rows = []
    for i, (revisit, response) in enumerate(cases):
        rows += [(2 * i, f"http://a.b/{i}", 1, 200, response, f"d{i}"), (2 * i + 1, f"http://a.b/{i}", 2, 304, revisit, None)]
    out = warc.resolve(spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>, digest string"))
    got = {r.record_id // 2: (r.outcome, r.digest) for r in out.collect()}
    want = ["no_validator", "no_validator", "validator_one_sided", "validator_one_sided", "validator_one_sided", "validator_one_sided", "resolved", "resolved"]
    taken = [x in ("no_validator", "resolved") for x in want]
    assert got == {i: (x, f"d{i}" if t else None) for i, (x, t) in enumerate(zip(want, taken, strict=True))}


def test_items_repeated_whole_are_one(spark):
    item = "the quick brown fox jumps over the lazy dog again"
    items = spark.createDataFrame([(1, item)] * 300 + [(2, item)], "item_id long, text string")
    out = decontamination.contaminated(docs(spark, [(5, "x " + item + " y")]), items)
    assert sorted((r.doc_id, r.item_id, r.distance) for r in out.collect()) == [(5, 1, 0), (5, 2, 0)]
    assert sum(len(b) for b in decontamination._blocks(items, decontamination.MatchParams())) == 2
