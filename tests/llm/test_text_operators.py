"""Each text operator against a brute-force version, and over awkward tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadence.llm import bpe, chat, license_scan, packing, pii, quality, registry, simhash, substring, topk, toxicity

from .helpers import AWKWARD, documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def sample(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# -- quality ------------------------------------------------------------------------------------


def slow_counts(text):
    w = words(text)
    n_words = len(w)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(n_words - 7))
    covered = set()
    for i in range(n_words - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    symbols = sum(c in "#*$%&|<>" for x in w for c in x)
    return n_words, sum(map(len, w)), symbols, dup, len(covered)


def test_quality_counts(spark, sample):
    texts = sample[:120] + [(i, t) for i, t in AWKWARD if t != "x" * 200_000] + [(50_000, "a b " * 40), (50_001, "l1 #x\nl2\nl1 #x\n \n \nl1 #x")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality.judge(documents(spark, texts, extra=True), labels).collect()
    assert len(found) == len(texts)
    expect = Counter((i, *slow_counts(t)) for i, t in texts)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == expect
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed)  # no labels certify nothing


def test_binomial_bound_is_exact():
    # P(X <= k) under the bound equals delta
    from math import comb

    for k, n, delta in ((0, 10, 0.05), (3, 50, 0.01), (10, 200, 0.002)):
        p = quality.upper_bound(k, n, delta)
        assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - delta) < 1e-9
    assert quality.upper_bound(0, 0, 0.05) == 1 and quality.upper_bound(5, 5, 0.05) == 1


def test_quality_certifies_what_a_plain_ladder_does(spark):
    """Cutoffs against counts by hand: one trial for each distinct text, conflicting labels out."""
    text = lambda i, stars: " ".join(f"w{i}x{j}{'*' * (j < stars)}" for j in range(30))
    good = [(i, text(i, i % 9 if i < 400 else 0)) for i in range(4000)]
    texts = good + [(9000 + i, good[3][1]) for i in range(3000)] + [(20_000, text(1, 30))]
    marks = [(i, 1, 0) for i, _ in texts] + [(5, 1, 0), (6, 0, 0), (7, None, 0)]
    docs = documents(spark, texts)
    limits = quality.cutoffs(quality.signals(docs), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), by_text=True).collect()
    trials = {t for i, t in texts if i != 6}
    assert [r.good for r in limits] == [len(trials)]
    share = lambda t: sum(c in "#*$%&|<>" for c in t) / len(t.replace(" ", ""))
    held = None
    for cutoff in quality.LADDERS["symbol_share"]:
        if quality.upper_bound(sum(share(t) > cutoff for t in trials), len(trials), quality.DELTA / len(quality.LADDERS)) > quality.RISK / len(quality.LADDERS):
            break
        held = cutoff
    assert limits[0].max_symbol_share == held


def test_quality_rejects_junk_within_its_risk(spark):
    good = [(i, " ".join(f"word{(i * 7 + j) % 501}{j}" for j in range(30))) for i in range(3000)]
    junk = [(10_000 + i, " ".join(f"w{i}{j}***" for j in range(30))) for i in range(50)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.judge(documents(spark, good + junk), labels).collect()}
    assert all(found[i].kept for i, _ in good)
    assert not any(found[i].kept for i, _ in junk) and not any(found[i].base_failed for i, _ in junk)
    kept = quality.keep(documents(spark, good + junk, extra=True), labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in good} and "rid" in kept.columns


# -- simhash ------------------------------------------------------------------------------------


def slow_fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            bits[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(shingles))


def slow_components(prints):
    """Positions to roots by links of two bits or fewer."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_simhash_joins_of_exploded_tables_are_never_broadcast(spark):
    """Spark sizes what an explode makes like the table before, which is under any limit here."""
    some = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    for found in (simhash._shared(simhash._index(some)), simhash._through(some)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_simhash_against_brute_force(spark, sample):
    texts = [x for x in sample + AWKWARD if x[0] is not None and len(x[1] or "") < 100_000]
    found = simhash.cluster(documents(spark, texts, extra=True)).collect()
    prints = [slow_fingerprint(t) for _, t in texts]
    least = {}
    roots = slow_components(prints)
    for (i, _), r in zip(texts, roots):
        least[r] = min(i, least.get(r, i))
    expect = Counter((i, p if p < 1 << 63 else p - (1 << 64), least[r]) for (i, _), p, r in zip(texts, prints, roots))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in found) == expect


@pytest.mark.parametrize("bucket", [2, 1000])
def test_links_lose_none_whatever_the_bucket(spark, bucket):
    rng = np.random.default_rng(5)
    prints = {0, (1 << 63) | 1}
    for base in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(25):
            x = base
            for bit in rng.integers(0, 64, int(rng.integers(0, 4))).tolist():
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    signed = [p if p < 1 << 63 else p - (1 << 64) for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bucket)
    from cadence.llm.components import connected_components

    found = {r.node: r.root for r in connected_components(edges).collect()}
    roots = slow_components(prints)
    groups = {}
    for s, r in zip(signed, roots):
        groups.setdefault(r, set()).add(s)
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_near_dedup_keeps_one_of_each_group(spark):
    text = " ".join(f"t{i}" for i in range(400))
    docs = documents(spark, [(3, text), (1, text), (1, text), (7, "all else is different here"), (None, "no id"), (None, "no id")])
    assert [(r.doc_id, r.text[:3]) for r in simhash.deduplicate(docs).orderBy("doc_id").collect()] == [(None, "no "), (1, "t0 "), (7, "all")]
    assert simhash.deduplicate(documents(spark, [])).count() == 0


# -- byte-level BPE -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_bpe():
    import tiktoken

    path, pattern = bpe.multi_bpe()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(spark, sample, reference_bpe):
    texts = sample[:80] + AWKWARD
    found = bpe.round_trip(documents(spark, texts, extra=True), *bpe.multi_bpe()).collect()
    expect = Counter()
    for i, t in texts:
        ids = reference_bpe.encode_ordinary(t or "")
        expect[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in found) == expect
    few = documents(spark, [x for x in texts if len(x[1] or "") < 1000])
    decoded = bpe.decode(bpe.encode(few, *bpe.multi_bpe()), *bpe.multi_bpe())
    assert rows(decoded) == rows(few.selectExpr("doc_id", "cast(coalesce(text, '') as binary)"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\r ab'stELé漢😀.!0\x1c\x85 ́", max_size=40))
def test_bpe_any_text(text):
    pairs = bpe.byte_pairs(*bpe.multi_bpe())
    if not hasattr(test_bpe_any_text, "library"):
        import tiktoken

        test_bpe_any_text.library = tiktoken.Encoding("any", pat_str=bpe.multi_bpe()[1], mergeable_ranks=pairs.ranks, special_tokens={})
    assert np.frombuffer(pairs.encode(text), "<u4").tolist() == test_bpe_any_text.library.encode_ordinary(text)


# -- packing ------------------------------------------------------------------------------------


def test_packing_places_each_token_once(spark, sample):
    from tokenizers import Tokenizer

    texts = sample + AWKWARD
    tokenizer = Tokenizer.from_file(packing.word_bpe_path())
    ids = {(i, t): np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in texts}
    found = packing.checksums(documents(spark, texts, extra=True), packing.word_bpe_path()).collect()
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0  # no padding at all
    wanted = Counter()
    for key in ids:
        wanted[key[0], len(ids[key])] += sum(x == key for x in texts)
    got = Counter()
    for r in found:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == Counter({k: k[1] * n for k, n in wanted.items()})
    single = {i: v for (i, t), v in ids.items() if sum(x[0] == i for x in texts) == 1}
    for r in found:
        if r.doc_id in single:
            assert r.ids_crc32 == zlib.crc32(single[r.doc_id][r.start : r.start + r.length].tobytes())
    with_ids = packing.pack(documents(spark, sample[:20]), packing.word_bpe_path()).collect()
    assert all(len(r.ids) == r.length for r in with_ids)
    assert packing.checksums(documents(spark, []), packing.word_bpe_path()).count() == 0


def test_nnls_and_combinations():
    rng = np.random.default_rng(1)
    a = rng.random((12, 30))
    x = np.where(rng.random(30) < 0.2, rng.random(30), 0)
    found = packing.nnls(a, a @ x)
    assert (found >= 0).all() and np.allclose(a @ found, a @ x, atol=1e-6)
    y = rng.random(12) - 0.5
    found = packing.nnls(a, y)
    gradient = a.T @ (y - a @ found)
    assert (gradient < 1e-6).all() and np.abs(gradient[found > 0]).max(initial=0) < 1e-6
    shapes = packing.combinations(16)
    assert (shapes @ np.arange(17) == 16).all() and len(set(map(tuple, shapes))) == len(shapes)
    histogram = np.array([5, 40, 0, 30, 10, 3, 0, 0, 9, 0, 0, 0, 2, 0, 0, 1, 0])
    used = sum(need * times for need, times in packing.repeats(histogram, 16))
    assert (used <= histogram).all() and used.sum() > 0.7 * histogram[1:].sum()


@pytest.fixture(scope="module")
def default_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.word_bpe_path())


_PIECES = [*" \nabKÉé.,!'’s漢0²…́İΣK|<>*­·ßǅª½ŉ\u00a0\u0085\x1c", "'re", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(_PIECES), max_size=20).map("".join))
def test_word_ids_any_text(default_tokenizer, text):
    cached = packing.word_ids(packing.word_bpe_path())
    assert np.frombuffer(cached.encode(text.encode()), cached.kind).tolist() == default_tokenizer.encode(text, add_special_tokens=False).ids


def test_word_ids_of_each_plain_character(default_tokenizer):
    cached = packing.word_ids(packing.word_bpe_path())
    for c in (chr(i) for i in range(0x21, 0x250) if packing._PLAIN.fullmatch(chr(i))):
        for text in (c, f"a{c}b", c + c, f"{c}1", f"É{c}"):
            assert np.frombuffer(cached.encode(text.encode()), cached.kind).tolist() == default_tokenizer.encode(text, add_special_tokens=False).ids


# -- personal data ------------------------------------------------------------------------------

SLOW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_base(text):
    out = []
    for k, (kind, pattern) in enumerate(SLOW.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab_@@..--+  ()12345670", max_size=40))
def test_pii_base_spans(text):
    assert [s[:3] for s in pii.find(text) if s.kind in pii.BASE] == slow_base(text)


def test_pii_kinds_and_redaction(spark, sample):
    text = "Write to a.b@c.example or +1 (366) 555-9807; card 4944339490429605, bank GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789, password=abc12345x host 10.0.0.1"
    assert [s.kind for s in pii.find(text)] == ["email", "phone", "card", "iban", "ssn", "secret", "ip"]
    clean = pii.redact(documents(spark, [(1, text), (2, None), (3, "nothing here")], extra=True)).orderBy("doc_id").collect()
    assert clean[0].text == "Write to <EMAIL> or <PHONE>; card <CARD>, bank <IBAN> and ssn <SSN>, password=<SECRET> host <IP>"
    assert clean[1].text is None and clean[2].text == "nothing here"
    assert pii.find("GB82 WEST 1234 5698 7654 33 and code 123-45-6789") == []
    assert pii.scan(documents(spark, AWKWARD)).count() == len(AWKWARD)
    texts = dict(sample)
    for r in pii.scan(documents(spark, sample)).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE] == slow_base(texts[r.doc_id])


def test_pii_context_on_either_side():
    spans = lambda text: [(s.kind, s.score) for s in pii.find(text)]
    assert spans("123-45-6789") == [] and spans("123-45-6789 is my taxpayer number") == spans("my ssn 123-45-6789") == [("ssn", 0.6)]
    assert spans("password=correcthorse") == [] and spans("the login has password=correcthorse") == [("secret", 0.6)]


def test_a_long_secret_goes_whole(spark):
    late, early = "x" * 200 + "7yz", "7" + "Ab/" * 100
    texts = [(1, f"token={late} end"), (2, f"api_key: '{early}' end"), (3, "token=" + "x" * 300)]
    found = {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind == "secret"] for r in pii.scan(documents(spark, texts)).join(documents(spark, texts).select("doc_id", "text"), "doc_id").collect()}
    assert found == {1: [late], 2: [early], 3: []}
    gone = {r.doc_id: r.text for r in pii.redact(documents(spark, texts)).collect()}
    assert "7yz" not in gone[1] and "Ab/" not in gone[2] and gone[3] == texts[2][1]


# -- toxicity -----------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(2)
    syllables = ["ka", "lo", "mi", "ren", "sta", "to", "ve", "shi"]
    word = lambda: "".join(rng.choice(syllables, 3))
    texts, labels = [], []
    for i in range(600):
        w = [word() for _ in range(int(rng.integers(5, 120)))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(w) // 30):
                w[int(rng.integers(0, len(w)))] = "zug" + str(rng.choice(["o", "ra", "ti"]))
        texts.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (5, 1, None), (99_999, 1, 1)]
    found = toxicity.score(documents(spark, texts + AWKWARD, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(found) == len(texts) + len(AWKWARD) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 600 and r.held_out and r.doc_id > 10]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.97
    none = toxicity.score(documents(spark, texts[:3]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert [r.predicted for r in none] == [0, 0, 0]


def slow_evidence(rows, words):
    """Kneser-Ney evidence from plain dictionaries of grams."""
    size, shared, discount = toxicity.ORDER, toxicity.SHARED, toxicity.DISCOUNT
    pad = lambda w: chr(2) * (size - 1) + w + chr(3)
    grams = lambda w: [pad(w)[i : i + size] for i in range(len(w) + 1)]
    level = {}
    for text, toxic in rows:
        for w in text.split():
            for g in grams(w):
                level.setdefault(g, [0, 0])[toxic] += 1
    models = []
    for order in range(size, 0, -1):
        contexts, below = {}, {}
        for g, n in level.items():
            c = contexts.setdefault(g[:-1], [0, 0, 0, 0])
            b = below.setdefault(g[1:], [0, 0])
            for k in (0, 1):
                c[k], c[2 + k] = c[k] + n[k], c[2 + k] + (n[k] > 0)
                b[k] = b[k] + (n[k] > 0) if order - 1 > shared else (b[k] + 1) * (k == 0)
        models.append((order, level, contexts))
        level = below
    out = []
    for w in words:
        total = 0.0
        for g in grams(w):
            p = [1 / 1024] * 2
            for order, counts, contexts in reversed(models):
                n, c = counts.get(g[size - order :], [0, 0]), contexts.get(g[size - order : -1], [0] * 4)
                for k in (0, 1):
                    j = k if order > shared else 0
                    if c[j]:
                        p[k] = max(n[j] - discount, 0) / c[j] + discount * c[2 + j] / c[j] * p[k]
            total += np.log(p[1]) - np.log(p[0])
        out.append(total)
    return out


def test_toxicity_keeps_every_gram_apart(spark):
    rng = np.random.default_rng(6)
    letters = [chr(0x4E00 + i) for i in range(4000)]
    # some 70,000 different 3-grams and more longer ones, which tables of a fixed size mix up
    texts = [(" ".join("".join(rng.choice(letters, 6)) for _ in range(100)), int(i % 4 == 0)) for i in range(150)]
    model = toxicity._tables(toxicity.gram_counts(spark.createDataFrame(texts, "text string, toxic int")))
    some = [w for text, _ in texts[::15] for w in text.split()] + ["unseen", letters[0] * 9]
    got = toxicity.evidence([w.encode() for w in some], model)
    assert got == pytest.approx(slow_evidence(texts, some), rel=1e-4, abs=1e-4)
    assert len(model["grams6"]) == len({("\2" * 5 + w + "\3")[i : i + 6] for t, _ in texts for w in t.split() for i in range(7)})


def test_toxicity_is_judged_by_length_normalised_passages():
    rng = np.random.default_rng(4)
    assert toxicity.features(np.zeros(0), np.zeros(0, int)) == (0.0, 0.0)
    for n in (1, 2, 3, 4, 50):
        ratios, lengths = rng.normal(size=n), rng.integers(2, 12, n)
        k = min(n, toxicity.PASSAGE)
        passages = [ratios[i : i + k].sum() / lengths[i : i + k].sum() for i in range(n - k + 1)]
        assert toxicity.features(ratios, lengths) == pytest.approx((ratios.sum() / lengths.sum(), max(passages)))
    long = np.full(5000, -0.5)
    long[[700, 701]] = 20.0  # two insults in a long text
    mean, passage = toxicity.features(long, np.full(5000, 6))
    assert mean < 0 < passage


def test_toxicity_of_held_out_rows_of_the_given_documents(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    found = registry.queries()["op6_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert found and sum(r.predicted == r.toxic for r in found) >= 0.9 * len(found)


def test_toxicity_of_a_model_too_large_to_send(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "漢", "té"], int(rng.integers(1, 5))))
    texts = [(i, " ".join([word() for _ in range(int(rng.integers(1, 40)))] + ["zugora", "zugora"] * (i % 3 == 0))) for i in range(20, 320)]
    texts += AWKWARD + [(50, texts[30][1]), (50, texts[30][1])]
    docs = documents(spark, texts, extra=True)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(320)], "doc_id long, quality int, toxic int")
    sent, joined = (sorted((tuple(r) for r in toxicity.score(docs, labels, **how).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2])) for how in ({}, {"broadcast_grams": 0}))
    assert len(sent) == len(texts) and [r[:2] for r in sent] == [r[:2] for r in joined]
    for a, b in zip(sent, joined):
        assert b[2:] == pytest.approx(a[2:], rel=1e-6, abs=1e-9)
    assert any(r[2] > 0.9 for r in sent) and any(r[2] < 0.1 for r in sent)
    assert toxicity.score(docs.limit(0), labels, broadcast_grams=-1).count() == 0


# -- personal data: scores -----------------------------------------------------------------------


def test_scores_stand_beside_their_spans(spark, sf):
    for r in registry.queries()["op5_pii"](spark, sf).where("spans <> ''").limit(50).collect():
        scores = r.scores.split(",")
        assert len(scores) == len(r.spans.split(",")) and all(0 <= float(x) <= 1 for x in scores)


# -- top-k search -------------------------------------------------------------------------------


def topk_by_hand(data, k=10):
    whole = lambda x: math.floor(Fraction(x) * 1024)
    sound = [(i, [whole(x) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, v in sound:
        if q % 100 == 0 and q not in out:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q and len(w) == len(v))[:k]
            out[q] = [(n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scores)]
    return {q: v for q, v in out.items() if v}


def topk_found(df, **how):
    rows_ = topk.integer_vectors(df)
    got = {}
    for r in topk.search(rows_.where("vec_id % 100 = 0"), rows_, **how).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


@pytest.mark.parametrize("how", [{}, {"sent_bytes": 0, "size": (3, 100)}])
def test_topk_against_brute_force(spark, how):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(0, 1, 16)]) for i in range(0, 950)]
    data += [(i, data[7][1]) for i in range(1000, 1040)]  # ties
    data += [(2000, None), (2001, [1.0, None] + [0.0] * 14), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (None, [0.5] * 16), (2100, [1.0] * 3), (2101, [2.0] * 3)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5).withColumn("dim", F.lit("x")).withColumn("vector", F.lit(0))
    assert topk_found(df, **how) == topk_by_hand(data)
    empty = topk.integer_vectors(df).limit(0)
    assert topk.search(empty, empty).count() == 0


@pytest.mark.parametrize("how", [{}, {"sent_bytes": 0, "size": (2, 7)}])
def test_topk_takes_vectors_of_any_size(spark, how):
    rng = np.random.default_rng(9)
    data = [(i, [float(x) for x in rng.normal(0, 1, 5)]) for i in range(60)]
    data += [(60 + i, [float(x) for x in rng.normal(0, 10.0 ** float(rng.integers(3, 12)), 5)]) for i in range(60)]
    data += [(200, [1e300, -3.7, 0.0, 2.0**200, 1.0]), (201, [1.7e308] * 5), (202, [-1.7e308, 1.0, 1.0, 1.0, 5e-324]), (203, [2.0**18, 0.0, 0.0, 0.0, 0.0]), (300, [-(2.0**53) - 2, 1.5, 2.0**31, 0.0, 1e9])]
    data += [(17, [1e6] * 5), (17, [9.0] * 5), (100, [5.0] * 5), (400, [0.0] * 5)]  # repeated vec_ids: 17 and perhaps 100
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    queries = [i for i, _ in data if i % 100 == 0]
    single = [x for x in data if queries.count(x[0]) < 2]
    once = spark.createDataFrame(single, "vec_id long, embedding array<double>").repartition(3)
    assert topk_found(once, **how) == topk_by_hand(single)
    assert set(topk_found(df, **how)) == set(queries)


def test_topk_repeated_rows_and_queries(spark):
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [262144.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    assert topk_found(df) == {0: [(1, 2, 1 << 38), (2, 3, 1 << 21), (3, 3, 1 << 21), (4, 1, 1 << 19)]}


# -- license scans ------------------------------------------------------------------------------


def test_license_scan(spark, sample):
    scanner = license_scan.Scanner()
    n, hits = scanner.scan("Released under the MIT  License. MIT licence, mit license mit license".encode())
    assert n == 11 and [(h.label, h.first_word, h.last_word) for h in hits if h.exact] == [("mit", 3, 4), ("mit", 7, 8), ("mit", 9, 10)]
    assert ("mit", 0, 4) in [(h.label, h.first_word, h.last_word) for h in hits if not h.exact]
    for text in ("x y Permision is hereby granted, free of charge, to any persons obtaining a copy of this sofware z", "Licensd under the Apache License Version 2.0"):
        found = [h for h in scanner.scan(text.encode())[1] if not h.exact]
        assert found and found[0].errors > 0
    assert scanner.scan(b"the permission was granted to nobody and the license office is closed")[1] == []
    for i, t in sample + AWKWARD:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        n, hits = scanner.scan((t or "").encode())
        places = [(label, k) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert n == len(w) and sorted((h.label, h.first_word) for h in hits if h.exact) == sorted(places)
    found = license_scan.scan(documents(spark, AWKWARD, extra=True)).collect()
    assert len(found) == len(AWKWARD)


def least_edits(pattern, text):
    """The least edit distance of the pattern to any stretch of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            last, row[i] = row[i], min(last + (p != c), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


def test_notices_are_found_up_to_their_errors_and_no_further():
    rng = np.random.default_rng(11)
    letters = list("abcdeilnorst ")
    scanner = license_scan.Scanner()
    for notice in scanner.notices:
        for edits in range(notice.errors + 3):
            body = list(notice.text)
            for _ in range(edits):
                at = int(rng.integers(0, len(body)))
                kind = int(rng.integers(0, 3))
                body[at : at + (kind != 1)] = [] if kind == 2 else [str(rng.choice(letters))]
            text = f"some words before {''.join(body)} and some after"
            line = " " + " ".join(text.split()) + " "
            expect = {n.text for n in scanner.notices if least_edits(n.text, line) <= n.errors}
            found = scanner._fuzzy(line)
            assert {h.label for h in found} == {n.label for n in scanner.notices if n.text in expect}
            words_ = text.split()
            for h in found:
                said = " ".join(words_[h.first_word : h.last_word + 1])
                assert any(least_edits(n.text, f" {said} ") <= n.errors for n in scanner.notices if n.label == h.label)


def test_every_place_of_a_notice_is_found_in_time_that_grows_with_the_text():
    import time

    scanner = license_scan.Scanner()
    one, exact = "licensed under a creative comons attribution 4 0 international license", "licensed under a creative commons attribution 4 0 international license"
    _, hits = scanner.scan(f"{one} x {exact} y {one}".encode())
    assert [(h.first_word, h.last_word, h.errors) for h in hits if h.label == "cc-by" and not h.exact] == [(0, 9, 1), (11, 20, 0), (22, 31, 1)]
    times = []
    for n in (4_000, 16_000):
        start = time.process_time()
        count, hits = scanner.scan(b"mit license " * n + f"{one} z ".encode() * (n // 40))
        times.append(time.process_time() - start)
        assert sum(h.exact for h in hits) == n and sum(h.label == "cc-by" and not h.exact for h in hits) == n // 40
    assert times[1] < 10 * times[0] + 1


# -- chat formatting ----------------------------------------------------------------------------


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "to]ol\n", "system"]), st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "[ROLE ", "\\", "<", "[", "a ", "]", "<\\/s>", "é"]), max_size=8).map("".join)), max_size=4))
def test_chat_round_trip(turns):
    rendered = [chat.render(r, t) for r, t in turns]
    assert chat.parse("".join(x[0] for x in rendered)) == [chat.Turn(r, t) for r, t in turns]
    for (line, a, b), (_, t) in zip(rendered, turns):
        assert chat.unescape(line[a:b]) == t


def test_chat_digests(spark):
    data = [(1, 1, "assistant", "yo </s>"), (1, 0, "user", "hi"), (2, None, None, None), (2, 0, "tool", "x"), (2, 0, "tool", "x"), (None, 0, "user", "n")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.digests(chat.format_turns(df)).collect()}
    assert found[1].n_turns == 2 and found[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nyo </s>\n").hexdigest()
    assert found[1].loss_chars == 7 and found[1].loss_sha256 == hashlib.sha256(b"yo </s>").hexdigest()
    assert found[2].turns_sha256 == hashlib.sha256(b"\n\ntool\nx\ntool\nx\n").hexdigest() and found[2].loss_chars == 0
    assert set(found) == {1, 2, None}
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


# -- substring dedup ----------------------------------------------------------------------------


def slow_repeats(texts, size=35):
    w = [(t or "").encode().split() for _, t in texts]
    seen = Counter(tuple(x[i : i + size]) for x in w for i in range(len(x) - size + 1))
    out = []
    for (doc_id, _), x in zip(texts, w):
        gone = [False] * len(x)
        for i in range(len(x) - size + 1):
            if seen[tuple(x[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((doc_id, len(x), sum(gone), hashlib.sha256(b" ".join(a for a, g in zip(x, gone) if not g)).hexdigest()))
    return Counter(out)


def test_substring_against_brute_force(spark, sample):
    body = sample[3][1]
    texts = sample + AWKWARD + [(70_000, "own words before " + body), (70_001, "a b c " * 60), (70_002, " ".join(map(str, range(35)))), (70_003, " ".join(map(str, range(36))))]
    found = substring.deduplicate(documents(spark, texts, extra=True), words_only=True).collect()
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in found)
    assert got == slow_repeats(texts)
    # a sketch too large to gather gives the same
    apart = substring.deduplicate(documents(spark, texts, extra=True), words_only=True, max_bits=4).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in apart) == got


def test_frequent_counters_of_a_spread_sketch_go_to_every_task(spark, monkeypatch):
    phrase = " ".join(f"p{i}" for i in range(40))
    texts = [(i, f"own{i} {phrase} end{i} " + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(120)] + AWKWARD
    docs = documents(spark, texts)
    want = slow_repeats(texts)
    for sent in (1, 8, 1 << 20):  # few counters count as frequent, and many
        monkeypatch.setattr(substring, "SENT", sent)
        monkeypatch.setattr(substring, "HOT", 4)
        monkeypatch.setattr(substring.repeated_places, "__defaults__", (4, 0))
        found = substring.deduplicate(docs, words_only=True, max_bits=0).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in found) == want


def test_substring_keeps_spacing(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    docs = documents(spark, [(1, f"Head  one.\n{passage}\n\ttail"), (2, f"other {passage}"), (3, "alone\n\n here"), (4, None)], extra=True)
    found = {r.doc_id: (r.text, r.n_removed) for r in substring.deduplicate(docs).collect()}
    assert found == {1: ("Head  one.\ntail", 50), 2: ("other ", 50), 3: ("alone\n\n here", 0), 4: (None, 0)}
    assert substring.deduplicate(documents(spark, [])).count() == 0


def test_a_phrase_of_many_documents_fills_no_single_bucket(spark):
    rng = np.random.default_rng(7)
    others = lambda: " ".join(f"o{n}" for n in rng.integers(0, 1 << 40, 40))
    phrase = " ".join(f"p{i}" for i in range(12))
    texts = [(i, f"{others()} {phrase} {others()}") for i in range(300)]
    texts += [(300, texts[7][1]), (301, f"{texts[8][1]} {others()}")]
    docs = documents(spark, texts).selectExpr("text", "doc_id as rid", "cast(0 as int) as rid2")
    bits, buckets, hot = 12, 64, 16
    bitmap, above = substring.sketch(docs, bits, hot)
    sizes, at = Counter(), {}
    # each half alone, as two tasks
    for half in (docs.where("rid % 2 = 0"), docs.where("rid % 2 = 1")):
        for b in substring._windows(half.toArrow().to_batches(), bits, bitmap, above, buckets, hot):
            for bucket, rid, payload in zip(*(b.column(c).to_pylist() for c in ("bucket", "rid", "payload"))):
                if rid is None:
                    entries = np.frombuffer(payload, substring._ENTRY)
                    sizes[bucket] += len(entries)
                    for h in entries["h1"].tolist():
                        at.setdefault(h, set()).add(bucket)
    assert max(sizes.values()) < sum(sizes.values()) / 6 and all(len(b) == 1 for b in at.values())
    places = lambda n: {(r.rid, p) for r in substring.repeated_places(docs, n).collect() for x in r.starts for p in np.frombuffer(x, "<u4").tolist()}
    assert places(hot) == places(1 << 30) == {(i, p) for i in (7, 8, 300, 301) for p in range(92 - 35 + 1)}


def test_sketch_never_underestimates():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    h[300:360] = h[100:160]
    least, chosen = substring.anchors(h)
    counts = Counter(chosen.tolist())
    windows = Counter(substring.rolled(h, 35).tolist())
    for a, w in zip(least.tolist(), substring.rolled(h, 35).tolist()):
        assert counts[a] >= min(2, windows[w])
