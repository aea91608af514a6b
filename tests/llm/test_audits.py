"""Filter audit, secret scans and source divergence against brute force, with the awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import string

import pytest

pytest.importorskip("cuewright.llm.queries")

from cuewright.llm import divergence, filter_audit, secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, Mask int, kind string, p double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "x", 0.5) for i, t, lang, s in rows], SCHEMA).repartition(5)


def make(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "CAPS", "a", "b$", "été", "Ölß", "x1y", "don't", "日本", " ", "zeta"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 30, 199, 200, 260])))
        rows.append((i, text, rng.choice(["en", "de", None, "", "fr"]), rng.choice(["s1", "s2", "s3", None])))
    rows += [(200 + i, "hot copy\tof one text", "en", "s1") for i in range(150)]  # a third of all rows
    rows += [(500, None, None, None), (501, "", "en", "s2"), (None, "hot copy\tof one text", "de", "s9"), (None, None, "en", "s1"), (None, "lone null", "en", "s1"), (None, "lone null", "en", "s1")]
    rows += [(7, rows[7][1], "en", "s1"), (7, "other " * 9, "en", "s1"), (-3, "late small id", "fr", "s1"), (900, "late small id", "fr", "s1"), (-3, "late small id", "de", "s1")]
    rows += [(901, "long " * 40_000 + "A" * 50_000, "xx", "only"), (902, "w " * 200, "zz", "s1"), (903, "w " * 200, "zz", "s2"), (904, "? ! 1", "qq", "s1"), (905, "one two", "qq", "s2")]
    return rows


def brute_masks(rows):
    key = lambda i: (i is None, i or 0)
    least = {}
    for i, t, *_ in rows:
        least[t or ""] = min(least.get(t or "", (2, 0)), key(i))
    for i, t, lang, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t) is not None, key(i) > least[t]]
        yield i, lang or "", sum(f << k for k, f in enumerate(fails))


@pytest.mark.parametrize("fingerprint", [filter_audit.AuditParams.fingerprint, lambda raw: len(raw) % 3])
@pytest.mark.parametrize("held", [1 << 20, 100])
def test_masks_survive_collisions_and_full_chains(spark, fingerprint, held):
    rows = make(1)
    p = filter_audit.AuditParams(fingerprint=fingerprint, held_bytes=held)
    got = collections.Counter()
    for r in filter_audit.masks(frame(spark, rows), p=p).collect():
        got[r.doc_id, r.part, r["mask"]] += r["rows"]
    assert got == collections.Counter(brute_masks(rows))


def test_audit_equals_running_every_order(spark):
    rows = make(2)
    labels = [(1, 1, 0), (1, 0, 1), (5, 1, None), (7, 1, 1), (201, 1, 1), (300, 0, 1), (None, 1, 1), (-3, 1, 0)]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out = filter_audit.audit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()}
    masks, want, total = list(brute_masks(rows)), {}, collections.Counter()
    for part in {m[1] for m in masks}:
        own = [(i, m) for i, p, m in masks if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [x for x in left if x[1] & bit]
                failing = [x for x in own if x[1] & bit]
                left = [x for x in left if not x[1] & bit]
                want[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(m == bit for _, m in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                total[part, f] += len(gone)
    assert got == {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def test_audits_of_empty_tables(spark):
    docs = frame(spark, make(1)).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    assert divergence.audit(docs).count() == 0
    assert secret_scan.digest(secret_scan.spans(docs)).count() == 0


def brute_divergence(rows, min_docs=3, ranks=200):
    fold = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for _, t, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(fold))
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)
        langwide = collections.Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})

        def weights(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // total for t in kept}

        p, ours = weights(counts[lang, source]), []
        for other in sources:
            if other != source:
                q = weights(counts[lang, other])
                ours.append((sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other))
        q = weights(langwide)
        over = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", ours, None), ("term", over, ranks)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(found[:most], 1)}
    return out


def test_divergence_equals_the_dense_sum(spark, monkeypatch):
    rows = make(3) + [(1000 + i, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(i % 7, 300, 1 + i % 5)), "en", f"s{i % 4}") for i in range(40)]
    monkeypatch.setattr(divergence, "HELD", 50)
    for ranks in (200, 5):
        got = [tuple(r) for r in divergence.audit(frame(spark, rows), ranks=ranks).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, ranks=ranks)


def test_weights_beyond_64_bits_are_exact(spark):
    pairs = [(0, 7), (8_999_999_999, 10**13), (9_000_000_000, 9 * 10**12 + 1), (5 * 10**14 + 17, 10**15 + 3)]
    got = spark.createDataFrame(pairs, "n long, t long").select(divergence.weight("n", "t").alias("p"), "n", "t").collect()
    assert all(r.p == 1 + 10**9 * (r.n + 1) // r.t for r in got)


def token(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def base_spans(t):
    found = []
    for k, (kind, (pattern, group, least)) in enumerate(secret_scan.BASE.items()):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t or "", re.ASCII) if len(m.group(group)) >= least]
    return [x[2] for x in sorted(found)]


def plant(rng):
    """Documents of ordinary text, some with one secret: (rows, {id: secret's span}, ids of others)."""
    b62 = string.ascii_letters + string.digits
    plain = ["theinternational", "conversationalist", "IMG_20231128_101455", "user-profile-settings", "articles/2023/some-long-title-here", "some", "words", "2023-11-28T10:14:55", "aaaaaaaaaaaaaaaaaaaa"]
    alphabets = [(b62, 32), (b62, 24), (b62 + "+/", 44), (string.ascii_uppercase + "234567", 40), (b62 + "-_", 43)]
    rows, secrets = [], {}
    for i in range(300):
        text = "é😀 " + " ".join(rng.choice(plain) for _ in range(20)) + " "
        if i % 5 == 0:
            secret = token(rng, *alphabets[i // 5 % len(alphabets)])
            secrets[i] = (len(text), len(text) + len(secret))
            text += secret + " end"
        rows.append((i, text, "en", "s"))
    return rows, secrets


def test_base_spans_equal_the_regex_module(spark):
    rng = random.Random(4)
    bits = ["token", "=", " : ", '"', "'", "ApI_Key", "PASSWD", "secret", "AKIA", "AKIAAKIA", "deadbeef", "0123456789abcdef", "Zz9+/_.=-", "é", "😀", "  ", "\n", "K", "tſken", "A1B2C3D4E5F6G7", "apikey"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60))), "en", "s") for i in range(300)]
    rows += [(400, None, "en", "s"), (401, "", "en", "s"), (None, "token=abcdefghijkl", "en", "s"), (3, "AKIA" + "X" * 14, "en", "s"), (402, "deadbeefdeadbeef " * 3000, "en", "s"), (403, "token" + " " * 50_000 + "x", "en", "s")]
    got = secret_scan.digest(secret_scan.spans(frame(spark, rows))).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()
    want = []
    for i, t, *_ in rows:
        base = base_spans(t)
        want.append((i, *(sum(x.startswith(k + ":") for x in base) for k in secret_scan.BASE), hashlib.sha256(",".join(base).encode()).hexdigest()))
    assert collections.Counter(tuple(r)[:-1] for r in got) == collections.Counter(want)
    texts = {i: t for i, t, *_ in rows[:300] if i != 3}
    for i, *_, spans in got:
        if i in texts:
            assert [x for x in spans.split(",") if x and not x.startswith("random")] == base_spans(texts[i])


def test_planted_secrets_are_found_and_words_are_not(spark):
    rows, secrets = plant(random.Random(5))
    found = secret_scan.spans(frame(spark, rows)).where("kind = 'random'").collect()
    right = {r.doc_id for r in found if secrets.get(r.doc_id) == (r.start, r.stop)}
    wrong = [r for r in found if secrets.get(r.doc_id) != (r.start, r.stop)]
    assert len(right) >= 0.9 * len(secrets) and len(wrong) <= 0.05 * len(found)


def battery(t, alphabet):
    """The battery's Fisher probability by plain loops and math.erfc."""
    n, k = len(t), len(alphabet)
    codes = [alphabet.index(c) + 1 for c in t]
    chi = k / n * sum(codes.count(c) ** 2 for c in set(codes)) - n
    z1 = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    high = [c > k / 2 for c in codes]
    a = sum(high)
    mu = 2 * a * (n - a) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    z2 = (1 + sum(x != y for x, y in itertools.pairwise(high)) - mu) / math.sqrt(var) if var > 0 else math.sqrt(n)
    mean = sum(codes) / n
    square = sum((c - mean) ** 2 for c in codes)
    z3 = (sum((x - mean) * (y - mean) for x, y in itertools.pairwise(codes)) / square + 1 / n) * math.sqrt(n) if square else math.sqrt(n)
    h = -sum(math.log(math.erfc(abs(z) / math.sqrt(2))) for z in (z1, z2, z3))
    return -h + math.log(1 + h + h * h / 2)


def test_battery_equals_plain_loops(spark):
    rng = random.Random(6)
    found = [(e, token(rng, a, n)) for e, a in secret_scan.ENCODINGS.items() for n in (16, 33, 64)] + [("base36", "a" * 19 + "0"), ("base36", "abcdefghijklmnopqrstuvwxyz0123456789")]
    got = secret_scan.battery(spark.createDataFrame(found, "want string, token string")).collect()
    for r in got:
        assert r.ln_random == pytest.approx(battery(r.token, secret_scan.ENCODINGS[r.encoding]), abs=1e-4)
        assert r.encoding == next(e for e, a in secret_scan.ENCODINGS.items() if set(r.token) <= set(a))  # a short token may fit a smaller alphabet


def test_random_tokens_pass_the_battery_at_its_level(spark):
    rng = random.Random(7)
    b62 = string.ascii_letters + string.digits
    rows = [(token(rng, b62, rng.choice([20, 32, 64])),) for _ in range(4000)]
    low = secret_scan.battery(spark.createDataFrame(rows, "token string")).where("exp(ln_random) < 0.01").count()
    assert low <= 120  # 1 % of 4000, with room for the approximations
