"""Spelling variants against a brute-force version by deletion sets."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cadence.llm import registry, spelling

from .helpers import AWKWARD, documents, rows

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_words(texts):
    n = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def brute(n):
    near, holes = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            holes[i, short].add(w)
            if short in n:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v and n[v] >= 10 * n[w] else None for w, v in best.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=repr)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("crowded", [8192, 3, 1])
def test_random_words_by_brute_force(spark, crowded):
    r = random.Random(7)
    n = {"".join(r.choice("abé") for _ in range(r.randint(7, 12))): 10 ** r.randint(0, 4) + 1 for _ in range(700)}
    n |= {"x" * 400 + c: 5 for c in "abc"} | {"x" * 399: 900, "abcdefg": 2, "abcdefgh": 30, "abcdefgz": 400, "tabcdefgz": 9000, "bcdefgz": 2}
    found = spelling.group(spark.createDataFrame(list(n.items()), "word string, n long"), crowded)
    assert found.columns == COLUMNS and rows(found) == brute(n)


def test_lists_are_scanned_in_small_parts(monkeypatch):
    words = sorted(a + b + c + "rest" for a in ("abc", "abd", "bbd") for b in "xyz" for c in ("", "u", "v"))

    def near():
        batches = spelling._scan(words, [3] * len(words), [(8, 0, 9, 1)] * len(words), [False] * len(words))
        return {w: (n, best) for b in batches for w, n, best in zip(*(b.column(c).to_pylist() for c in ("word", "n_near", "near")))}

    whole = near()
    monkeypatch.setattr(spelling, "QUERIES", 2)
    assert near() == whole and whole["abcxrest"] == (5, "abcxurest")


def test_awkward_documents(spark):
    variants = [(20 + i, "Commonword commonword COMMONWORD commonwörd " * 3 + "commonwords comonword xcommonword") for i in range(40)]
    texts = [*AWKWARD, *variants]
    for extra in (False, True):
        docs = documents(spark, texts, extra)
        got = spelling.group(spelling.materialise(spelling.vocabulary(docs), "words"))
        assert rows(got) == brute(brute_words(texts))
    assert any(r[1] == "commonword" for r in rows(got))


def test_empty_table(spark):
    assert spelling.group(spelling.vocabulary(documents(spark, []))).collect() == []


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows(registry.queries()["op11_spelling"](spark, sf).select(*COLUMNS)) == brute(brute_words(docs))
