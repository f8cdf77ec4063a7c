"""Operators over texts: every edge case against a brute-force version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from placeprint.llm import bpe, grace_dedup, langid, lm, mixing, sanitise, simhash, token_scan

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, fp long, bucket string, `group` int"
LONG = "xyzzy " * 4000 + "z" * 5000


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "le", "déjà", "vu", "Straße", "über", "año", "ñandú", "don't", "x1", "100", "日本"]
    out = [(None, "no id", "en"), (1, None, "en"), (2, "", "fr"), (3, " \t\n", None), (4, LONG, "en"), (5, "a b", "de"), (6, "A B", "de"), (7, "12 34 !!", "es"), (8, None, None), (8, None, None)]
    out += [(10 + i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40))), rng.choice(["en", "fr", "de"])) for i in range(n)]
    out += [(200 + i, out[10 + i % 7][1], "en") for i in range(20)] + [(11, out[11][1], "en")]
    return [(i, t, lang, rng.choice(["s0", "s0", "s1", None]), len(t or ""), 1, 2, "b", 3) for i, t, lang in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips(spark, docs, reference):
    got = bpe.bpe_encode(docs, RANKS, public_tokenizers.PATTERN).select("doc_id", "text", "bpe.*", bpe.decoder(spark, RANKS, public_tokenizers.PATTERN)("bpe.ids").alias("back")).collect()
    assert len(got) == docs.count()
    for r in got:
        want = np.array(reference.encode_ordinary(r["text"] or ""), dtype="<u4").tobytes()
        raw = (r["text"] or "").encode()
        assert bytes(r["ids"]) == want and r["n_tokens"] == len(want) // 4 and bytes(r["back"]) == raw
        assert r["ids_sha256"] == hashlib.sha256(want).hexdigest() and r["decoded_sha256"] == hashlib.sha256(raw).hexdigest()


def test_bpe_matrices_and_heap_agree(reference):
    v = bpe.Vocabulary(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(60):
        piece = bytes(rng.choice(b"abcde\xc3\xa9 \xff\x00") for _ in range(rng.randint(1, 90)))
        assert v.merge_matrix([piece, piece[: len(piece) // 2 + 1]])[0].tolist() == v.merge_long(piece).tolist()
    long = "".join(rng.choice("abé") for _ in range(4000))
    assert v.encode_all([long, "", " ok"])[0] == np.array(reference.encode_ordinary(long), dtype="<u4").tobytes()


def test_bpe_empty_table(empty):
    assert bpe.bpe_encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def brute_fingerprint(text):
    words = [w for w in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, ids, tau=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        k = find(i)
        if d is not None:
            least[k] = min(d, least.get(k, d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_equals_brute_force(docs):
    got = simhash.near_dedup(docs).collect()
    data = docs.collect()
    fps = [brute_fingerprint(r["text"]) for r in data]
    want = Counter(zip([r["doc_id"] for r in data], [f - (1 << 64) if f >> 63 else f for f in fps], brute_components(fps, [r["doc_id"] for r in data])))
    assert Counter((r["doc_id"], r["fp"], r["component_id"]) for r in got) == want


@pytest.mark.parametrize("bucket_rows", [2, 512])
@pytest.mark.parametrize("parts", [2, 3, 4])
def test_simhash_links_lose_nothing(spark, bucket_rows, parts):
    """Dense balls, chains and correlated bits; small buckets force the way by midpoints."""
    rng = random.Random(parts)
    fps = {rng.getrandbits(64) for _ in range(40)} | {rng.getrandbits(10) << 3 for _ in range(60)}
    for f in list(fps)[:30]:
        for _ in range(4):
            f ^= 1 << rng.randrange(64)
            fps.add(f)
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), parts=parts, bucket_rows=bucket_rows).collect()
    at = {s: i for i, s in enumerate(signed)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[find(at[a])] = find(at[b])
    have = [find(i) for i in range(len(fps))]
    want = brute_components(fps, list(range(len(fps))))
    assert len(set(zip(have, want))) == len(set(have)) == len(set(want))


def test_simhash_allocation_sums_and_is_least():
    rng = np.random.default_rng(0)
    cost = np.cumsum(rng.random((50, 3, 3)), axis=2)
    got = simhash.allocate(cost, 2)
    assert (got.sum(axis=1) == 0).all()
    grid = [(a, b, -a - b) for a in range(-1, 3) for b in range(-1, 3) if -1 <= -a - b <= 2]
    price = lambda i, t: sum(cost[i, g, e] for g, e in enumerate(t) if e >= 0)
    assert all(abs(price(i, got[i]) - min(price(i, t) for t in grid)) < 1e-12 for i in range(50))


def test_drop_near(docs, empty):
    keep = {r["doc_id"] for r in simhash.near_dedup(docs).collect() if r["doc_id"] is None or r["doc_id"] == r["component_id"]}
    out = simhash.drop_near(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == keep
    assert simhash.near_dedup(empty).count() == simhash.drop_near(empty).count() == 0


@pytest.mark.parametrize("table_bytes", [200, 1 << 25])
def test_grace_dedup_equals_brute_force(docs, empty, table_bytes):
    data, groups = docs.collect(), defaultdict(list)
    for r in data:
        groups[r["text"] or ""].append(r["doc_id"])
    got = grace_dedup.exact_dedup(docs, table_bytes=table_bytes).collect()
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((r["doc_id"], top[r["text"] or ""], len(groups[r["text"] or ""]), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in data)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert all(r["doc_id"] == r["keep_id"] for r in kept) and len(kept) == len(groups) == len({r["text_sha256"] for r in kept})
    whole = grace_dedup.drop_exact(docs, table_bytes=table_bytes)
    assert whole.columns == docs.columns
    assert Counter((r["text"] or "", r["doc_id"]) for r in whole.collect()) == Counter((t, i) for t, i in top.items())
    assert grace_dedup.exact_dedup(empty).count() == grace_dedup.drop_exact(empty).count() == 0


def test_content_table_keeps_colliding_hashes_apart():
    t = grace_dedup.ContentTable()
    assert [t.put(7, x)[0] for x in (b"a", b"b", b"a")] == [0, 1, 0]
    assert all(t.put(5, str(i).encode())[1] for i in range(3000)) and not t.put(5, b"17")[1]


def test_language_id(spark, sf_dir, docs, empty):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(langid.training_rows(table))
    out = langid.identify(table, model).select("doc_id", "lang", "language.*", langid.held_out("doc_id", 4).alias("held"))
    test = [r for r in out.collect() if r["held"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in test)
    assert sum(r["lang_pred"] == r["lang"] for r in test) / len(test) > 0.95
    assert all(0 <= r["score"] <= 1 for r in test)
    edge = {r["doc_id"]: r["language"] for r in langid.identify(docs, model).collect()}
    assert all(edge[i]["lang_pred"] == "und" and edge[i]["score"] == 0 for i in (1, 2, 3, 7, 8)) and edge[4]["lang_pred"] != "und"
    nothing = langid.fit(langid.training_rows(empty))
    assert {r["language"]["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_language_backoff_takes_the_longest_known_order():
    keys = {n: np.array(sorted(int(k) for k in langid.gram_keys(langid._codes([w], n), n).ravel()), dtype=np.uint64) for n, w in ((2, "ab"), (1, "a"))}
    grams = {2: (keys[2], np.tile([[-1.0, -5.0]], (len(keys[2]), 1))), 1: (keys[1], np.array([[-7.0, -2.0]]))}
    model = langid.Model(["x", "y"], {"word": 0}, np.array([[-3.0, -4.0]]), grams)
    assert model.vectors(["word", "ab", "ca", "q"]).tolist() == [[-3, -4], [-1, -5], [-7, -2] if not set(keys[2]) & set(langid.gram_keys(langid._codes(["ca"], 2), 2).ravel()) else [-1, -5], [0, 0]]


def test_lm_equals_brute_force(spark, docs, empty):
    held, deleted = langid.held_out("doc_id", 7), langid.held_out("doc_id", 7, 3)
    settings = lm.Settings(block_bytes=300, shard_tokens=50)
    got = lm.score(docs, held, deleted, settings).collect()
    data = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect()]
    fold = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 7
    uni, bi, ctx = Counter(), Counter(), Counter()
    rest = [Counter(), Counter(), Counter()]
    for i, words in data:
        if fold(i) == 2:
            continue
        tokens = [*words, b" end"]
        for tables in ([(uni, bi, ctx)] if fold(i) == 3 else [(uni, bi, ctx), rest]):
            for a, b in zip([b" start", *tokens], tokens):
                tables[0][b] += 1
                tables[1][a, b] += 1
                tables[2][a] += 1
    n, v, n_rest = sum(uni.values()), len(uni), sum(rest[0].values())
    level = lambda p: -1 if p <= 0 else round(-math.log2(p) / settings.step)
    cells = Counter()
    for i, words in data:
        if fold(i) == 3:
            tokens = [*words, b" end"]
            for a, b in zip([b" start", *tokens], tokens):
                c = rest[2][a]
                cells[int(lm.bucket(np.array([c]))[0]), level(rest[1][a, b] / max(c, 1)), level(rest[0][b] / n_rest)] += 1
    w = lm.learn_weights(np.array([[*k, m] for k, m in cells.items()]).reshape(-1, 4), v, settings)
    assert np.allclose(w.sum(axis=1), 1) and (w[:, 2] > 0).all()
    want = Counter()
    for i, words in data:
        tokens = [*words, b" end"]
        base = sum(math.log10((uni[t] + 1) / (n + v + 1)) for t in tokens)
        full = 0.0
        for a, b in zip([b" start", *tokens], tokens):
            x = w[int(lm.bucket(np.array([ctx[a]]))[0])]
            full += math.log10(x[0] * bi[a, b] / max(ctx[a], 1) + x[1] * uni[b] / n + x[2] / (v + 1))
        want[i, fold(i) == 2, len(tokens), sum(uni[t] > 0 for t in tokens), n, round(base, 6), round(full, 5)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 5)) for r in got) == want
    assert lm.score(empty, held, deleted).count() == 0
    all_held = lm.score(docs, F.lit(True), deleted).collect()
    assert all(r["train_tokens"] == 0 and math.isfinite(r["score"]) and r["n_known"] == 0 for r in all_held)


def test_lm_planes_round_trip():
    for x in (np.array([], dtype=np.uint64), np.array([0, 255, 256, 2**63], dtype=np.uint64)):
        assert lm.unplanes(lm.planes(x), len(x)).tolist() == x.tolist()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for i, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".") if len(x) < 4000) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and sanitise.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    parts = ["a@b.c", "x.y+z@mail-1.ex.org", "@", "a@b", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4539 1488 0343 6467", "4539-1488-0343-6467", "1234 5678", "+1 (555) 123-4567", "+12", "++49 30 1234567", " ", "日", "_", ".", "-", "0001.002.3.4"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 8)))
        assert sanitise.base_spans(text) == brute_spans(text), text
    for text in ("a" * 50_000, "1" * 50_000, "@" * 20_000, "a@" * 10_000, "1." * 20_000, "+1" + "(" * 20_000):
        assert isinstance(sanitise.base_spans(text), list)


def test_sanitise_finds_disclosing_terms(spark, empty):
    common = "one two three four five six seven"
    data = [(i, f"{common} filler{i % 5} nothing here", *[None] * 7) for i in range(200)]
    data += [(300, f"alpha zorgon writes to ann.ex@mail.org {common} one", *[None] * 7), (301, f"beta zorgon asks ann.ex@mail.org {common} two three", *[None] * 7), (302, "write to only@once.org zeppelin", *[None] * 7), (303, None, *[None] * 7), (None, "", *[None] * 7)]
    docs = spark.createDataFrame(data, SCHEMA)
    got = {r["doc_id"]: r for r in sanitise.find_private(docs).collect()}
    assert len(got) == len({d[0] for d in data})
    said = lambda i: [(s["kind"], data_text[i][s["start"] : s["end"]]) for s in got[i]["spans"]]
    data_text = {d[0]: d[1] for d in data}
    assert ("term", "zorgon") in said(300) and ("term", "zorgon") in said(301) and ("email", "ann.ex@mail.org") in said(300)
    assert not any(t in ("one", "two", "three") for k, t in said(300) if k == "term")
    assert said(302) == [("email", "only@once.org")] and all(not got[i]["spans"] for i in range(200))
    assert not got[303]["spans"] and got[303]["counts"] == [0, 0, 0, 0] and got[303]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = sanitise.find_private(docs).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", sanitise.redact()("text", "spans").alias("t"))
    text = {r["doc_id"]: r["t"] for r in clean.collect()}
    assert "[email]" in text[300] and "zorgon" not in text[300] and text[5] == data_text[5]
    assert sanitise.find_private(empty).count() == 0


def test_sanitise_marks_terms_at_any_distance(spark):
    """A name in the head of a letter, the address in its foot, and the name again far from both."""
    fill = lambda i: " ".join(f"word{(i * 7 + k) % 40}" for k in range(60))
    data = [(i, fill(i), *[None] * 7) for i in range(300)]
    data += [(400 + i, f"Zorgon {fill(i)} zorgon {fill(i + 1)} ann.ex@mail.org", *[None] * 7) for i in range(3)]
    text = {d[0]: d[1] for d in data}
    got = {r["doc_id"]: r["spans"] for r in sanitise.find_private(spark.createDataFrame(data, SCHEMA)).collect()}
    for i in (400, 401, 402):
        said = [(s["kind"], text[i][s["start"] : s["end"]], s["action"]) for s in got[i]]
        assert said == [("term", "Zorgon", "remove"), ("term", "zorgon", "remove"), ("email", "ann.ex@mail.org", "mask")]
    assert not any(got[i] for i in range(300))


def test_sanitise_counts_terms_as_it_finds_them(spark):
    """Lower-casing a capital dotted I adds a character that isn't part of a word."""
    data = [(i, f"one two three four filler{i % 5}", *[None] * 7) for i in range(200)]
    data += [(300 + i, f"{name} \u0130stanbul writes to ann.ex@mail.org one", *[None] * 7) for i, name in enumerate(("alpha", "beta"))]
    got = {r["doc_id"]: r["spans"] for r in sanitise.find_private(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all("\u0130stanbul" in [data[200 + i][1][s["start"] : s["end"]] for s in got[300 + i]] for i in (0, 1))


def test_token_scan_counts(spark, docs, empty):
    got = token_scan.count_tokens(docs, bytes_a_file=500, block=7).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode().split())) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want
    assert token_scan.count_tokens(empty).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 5, 1000])
def test_token_scan_stitches_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    files = {f"f{k}": [rng.choice([0, 0, 3, 9]) for _ in range(rng.randint(0, 40))] for k in range(6)} | {"none": [], "open": [5, 6], "closed": [0]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, dtype="<u2").tobytes())
    want = Counter()
    for name, ids in files.items():
        doc, n = 0, 0
        for x in ids:
            if x:
                n += 1
            else:
                want[name, doc, n, True] += 1
                doc, n = doc + 1, 0
        if n:
            want[name, doc, n, False] += 1
    got = token_scan.scan_flat(spark, str(tmp_path), block=block).collect()
    assert Counter((r["path"].rsplit("/", 1)[1], r["doc"], r["n_tokens"], r["ended"]) for r in got) == want


def test_mixing_budgets():
    tokens = [1000, 100, 10]
    s = mixing.Settings(entropy=0.9, max_repeat=1000)
    a = mixing.exponent(tokens, s)
    shares = [t / 1110 for t in tokens]
    assert abs(mixing.entropy(mixing.weights_at(shares, a)) - 0.9 * math.log(3)) < 1e-9
    limited = mixing.Settings(entropy=0.99, max_repeat=4)
    b = mixing.exponent(tokens, limited)
    w = mixing.weights_at(shares, b)
    assert w[2] * 1110 / 10 <= 4 + 1e-9 and b > mixing.exponent(tokens, mixing.Settings(entropy=0.99, max_repeat=1e9))
    assert mixing.exponent([5, 5], s) == 1.0 and mixing.exponent([5], s) == 1.0


def test_mixing_budgets_lose_no_source():
    """Sources far below a millionth, and ones whose weight is no whole millionth."""
    tiny = [1_670_000_000] * 3 + [500]
    assert mixing.budgets(tiny, mixing.Settings())[3][1] >= 500
    natural = mixing.Settings(entropy=None)
    equal = [25_000_000 + i for i in range(200)]
    for tokens in (tiny, equal, [7], [3, 1, 10**15]):
        assert [b for _, b in mixing.budgets(tokens, natural)] == tokens
    zipf = [5_000_000_000 // 3] + [math.floor(1e9 / i**1.5) + 1 for i in range(1, 99_999)]
    got = mixing.budgets(zipf, mixing.Settings())
    assert sum(b for _, b in got) == sum(zipf) and min(b for _, b in got) > 0


def test_mixing_takes_what_the_budget_buys(spark, docs, empty):
    out = mixing.mix(docs, mixing.Settings(entropy=1.0, max_repeat=3.0)).select("doc_id", "source", "mix_epoch", "text").collect()
    data = docs.collect()
    words = lambda t: len((t or "").encode().split())
    total = Counter()
    for r in data:
        total[r["source"]] += words(r["text"])
    names = sorted(total, key=lambda s: (s is not None, s or ""))
    plan = dict(zip(names, mixing.budgets([total[s] for s in names], mixing.Settings(entropy=1.0, max_repeat=3.0))))
    by = Counter()
    for r in out:
        by[r["source"]] += words(r["text"])
    copies = Counter((r["doc_id"], r["text"], r["source"]) for r in out)
    own = Counter((r["doc_id"], r["text"], r["source"]) for r in data)
    largest = max(words(r["text"]) for r in data)
    for s, (_, budget) in plan.items():
        assert budget - largest <= by[s] <= budget
        assert all(own[k] * (budget // total[s]) <= copies[k] <= own[k] * (budget // total[s] + 1) for k in own if k[2] == s)
    assert mixing.mix(empty).count() == 0


def test_pipeline_equals_its_parts(spark, sf_dir, reference):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES][0] == "language ID" and len(p.STAGES) == 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(langid.training_rows(docs))
    rows_ = [r for r in langid.identify(docs, model).collect() if r["language"]["lang_pred"] != "und" and r["language"]["score"] >= p.LEAST_SCORE]
    last = {}
    for r in sorted(rows_, key=lambda r: r["doc_id"]):
        last[r["text"] or ""] = r
    kept = list(last.values())
    fps = [brute_fingerprint(r["text"]) for r in kept]
    kept = [r for r, c in zip(kept, brute_components(fps, [r["doc_id"] for r in kept])) if r["doc_id"] == c]
    mixed = mixing.mix(spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in kept], docs.schema)).collect()
    want = Counter((r["doc_id"], r["source"], hashlib.sha256(np.array(reference.encode_ordinary(r["text"] or ""), dtype="<u4").tobytes()).hexdigest()) for r in mixed)
    got = p.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["source"], r["ids_sha256"]) for r in got) == want
    for _, stage in p.STAGES[:4]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_pipeline_stages_on_edge_cases(spark, docs, empty, sf_dir):
    import corpus_pipeline as p

    for table in (docs, empty):
        for _, stage in p.STAGES:
            assert stage(spark, table, sf_dir).count() <= 3 * table.count()
