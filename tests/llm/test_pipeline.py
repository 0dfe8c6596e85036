"""The pipeline against the same stages by brute force, and every operator on empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from cadence.llm import bpe, chat, language, license_scan, packing, pii, quality, registry, simhash, spelling, substring, topk, toxicity

from .helpers import AWKWARD, documents
from .test_text_operators import WORD, slow_components, slow_counts, slow_fingerprint


def slow_cut(texts, size=35):
    """Texts without repeated words and the white space after them."""
    tokens = [[(m.start(), m.group()) for m in WORD.finditer(t)] for t in texts]
    seen = Counter(tuple(w for _, w in x[i : i + size]) for x in tokens for i in range(len(x) - size + 1))
    out = []
    for t, x in zip(texts, tokens):
        gone = set()
        for i in range(len(x) - size + 1):
            if seen[tuple(w for _, w in x[i : i + size])] > 1:
                gone.update(range(i, i + size))
        ends = [p for p, _ in x[1:]] + [len(t)]
        out.append(t[: x[0][0]] + "".join(t[p:e] for i, ((p, _), e) in enumerate(zip(x, ends)) if i not in gone) if gone else t)
    return out


def test_pipeline_against_brute_force(spark, sf):
    given = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    # So few labels certify no cutoff: the base rules decide.
    docs = [(i, t) for i, t in given if (c := slow_counts(t))[0] >= 20 and 100 * c[4] <= 30 * c[0]]
    roots = slow_components([slow_fingerprint(t) for _, t in docs])
    docs = [d for k, d in enumerate(docs) if roots[k] == k]
    texts = slow_cut([t for _, t in docs])
    texts = [pii.redacted(t, pii.find(t)) for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.word_bpe_path())
    expect = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4") for (i, _), t in zip(docs, texts)}
    pieces = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(expect)
    for i, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(expect[i])
            assert r.ids_crc32 == zlib.crc32(expect[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(expect[i])


def test_stages_return_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert 0 < out.count() <= docs.count()


def test_stages_take_awkward_rows(spark, sf):
    """Nulls, empty and very long texts, repeated rows and clashing columns, against brute force."""
    docs = documents(spark, AWKWARD, extra=True)
    got = {name: stage(spark, docs, sf) for name, stage in corpus_pipeline.STAGES}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert tuple(got[name].columns) == corpus_pipeline.COLUMNS, name
    found = {name: [(r.doc_id, r.text) for r in df.collect()] for name, df in got.items() if name != "packing"}
    counts = {t: slow_counts(t) for _, t in AWKWARD if t not in (AWKWARD[-1][1], AWKWARD[-2][1])}
    # the labels of sf certify no cutoff: the base rules decide
    assert Counter(found["quality"]) == Counter(x for x in AWKWARD if x[1] in counts and counts[x[1]][0] >= 20 and 100 * counts[x[1]][4] <= 30 * counts[x[1]][0])
    # 1 to 3 have no words; 7 and 8 are copies
    assert sorted(i or 0 for i, _ in found["near_dedup"]) == [0, 1, 4, 5, 6, 7, 9, 10]
    cut = dict(found["substring_dedup"])
    assert cut[1] is None and cut[7] == cut[8] == "" and all(cut[i] == t for i, t in AWKWARD if i not in (7, 8))
    assert Counter(found["pii"]) == Counter((i, t and pii.redacted(t, pii.find(t))) for i, t in AWKWARD)
    tokens = Counter()
    for r in got["packing"].collect():
        tokens[r.doc_id] += r.length
    assert tokens[1] == tokens[2] == tokens[3] == 1 and tokens[8] == 2 * tokens[7] and set(tokens) == {i for i, _ in AWKWARD}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, [], extra=True), sf).count() == 0, name


def test_queries_by_name(spark, sf):
    """Each registered query over a given table, with its SQL where there is some."""
    import duckdb

    found = {name: query(spark, sf) for name, query in registry.queries().items()}
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, df in found.items():
        if name not in ("op4_packing", "op7_topk", "op9_chat", "op11_spelling", "op12_hard_negatives"):
            assert df.count() == n, name
    duck = duckdb.connect()
    for t in ("embeddings", "conversations"):
        duck.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        wanted = duck.sql(sql)
        assert Counter(tuple(r[c] for c in wanted.columns) for r in found[name].collect()) == Counter(wanted.fetchall()), name
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in found["op5_pii"].collect():
        spans = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in pii.find(texts[r.doc_id] or "") if s.kind in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    for r in found["op8_licenses"].collect():
        places = [h for h in license_scan.Scanner().scan((texts[r.doc_id] or "").encode())[1] if h.exact] if r.n_base else []
        assert r.n_base == len(places) and r.first_word == min((h.first_word for h in places), default=None) and r.last_word == max((h.first_word for h in places), default=None)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_empty_tables(spark):
    docs = documents(spark, [], extra=True)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path, pattern = bpe.multi_bpe()
    for out in (
        quality.judge(docs, labels), quality.keep(docs, labels), simhash.cluster(docs), simhash.deduplicate(docs), bpe.round_trip(docs, path, pattern), bpe.encode(docs, path, pattern),
        packing.pack(docs, packing.word_bpe_path()), pii.scan(docs), pii.redact(docs), toxicity.score(docs, labels), license_scan.scan(docs), substring.deduplicate(docs), spelling.group(spelling.vocabulary(docs)), language.predict(docs, {"en": b"a"}),
    ):
        assert out.count() == 0
    vectors = topk.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.search(vectors, vectors).count() == 0
    assert chat.digests(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_word_pattern_is_that_of_bytes_split():
    text = "".join(map(chr, range(0, 0x180)))
    assert [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)] == text.encode().split()
