"""The queries against DuckDB where SQL expresses them, else against brute force or held-out labels, over whole tables."""

import base64
import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from percepta.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def run(spark, name):
    return queries.queries()[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, duck, name):
    def rows(df):
        cols = sorted(df.columns)
        df = df[cols].astype(object)
        return cols, sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))

    assert rows(queries.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(queries.oracle_sql()[name]).df())


def test_warc_equals_brute_force(spark, duck):
    pages = [(i, (h or "").encode()) for i, h in duck.sql("SELECT page_id, html FROM pages").fetchall()]
    last = {}
    for i, h in pages:
        last[h] = max(i, last.get(h, i))
    want = {(i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, h in pages}
    assert {tuple(r) for r in run(spark, "op2_warc")} == want


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(sets, percent=80):
    """Least id that links reach, by an inverted index of all shingles."""
    parent, index = {i: i for i in sets}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(i)
    both = Counter(tuple(sorted((a, b))) for ids in index.values() for k, a in enumerate(ids) for b in ids[:k])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n) and root(a) != root(b):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: root(i) for i in sets}


def test_minhash_equals_brute_force(spark, duck):
    sets = {i: shingles(t, 4) for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}
    least = components(sets)
    assert {tuple(r) for r in run(spark, "op3_minhash_near_dedup")} == {(i, len(s), least[i], least[i] == i) for i, s in sets.items()}


def test_decontamination_equals_brute_force(spark, duck):
    """All windows of all documents, by their counts of shingles."""
    docs, items = (duck.sql(f"SELECT * FROM {t}").df() for t in ("documents", "benchmark"))
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    said = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for i, t in zip(items.item_id, items.text, strict=True)}
    own = {i: grams(w) for i, w in said.items() if w}
    distinct = {tuple(sorted(c.items())): c for c in own.values()}
    df = Counter(g for c in distinct.values() for g in c)
    idf = lambda g: np.log(1 + len({tuple(w) for w in said.values() if w}) / df.get(g, 1))
    mass = lambda c: sum(n * idf(g) for g, n in c.items())
    index = {}
    for i, c in own.items():
        for g in c:
            index.setdefault(g, set()).add(i)
    want = {}
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        for i in {i for g in grams(w) for i in index.get(g, ())} if w else ():
            n = len(said[i])
            for at in range(max(len(w) - n, 0) + 1):
                c = grams(w[at : at + n])
                if not c.keys() & own[i].keys():
                    continue
                s = mass(c & own[i]) / mass(c | own[i])
                if s >= 0.8 - 1e-9 and s > want.get((doc_id, i), (0, 0))[0] + 1e-9:
                    want[doc_id, i] = (s, at)
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in run(spark, "op4_decontamination")}
    assert len(got) > 10 and got.keys() == want.keys()
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-6) and got[k][1] == want[k][1] for k in got)


ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(ASSIGN, text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_secrets_equal_brute_force(spark, duck):
    rows = {r.doc_id: r for r in run(spark, "op5_secret_scan")}
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        spans = base_spans(text or "")
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        kinds = Counter(k for *_, k in spans)
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(rows[i].spans.split(","))
    assert any("identifier:" in r.spans for r in rows.values())


@pytest.mark.parametrize(("name", "label", "parts", "rest", "cut"), [("op8_quality_classifier", "quality", 4, 2, 0.7), ("op9_toxicity", "toxic", 5, 0, 0.5)])
def test_classifiers(spark, duck, name, label, parts, rest, cut):
    import zlib

    rows = {r.doc_id: r for r in run(spark, name)}
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert rows.keys() == texts.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % parts == rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= cut) for i, r in rows.items())
    by_text = {}
    for i, t in texts.items():
        by_text.setdefault(t, set()).add(rows[i].score)
    assert all(len(v) == 1 for v in by_text.values())
    y = [(rows[i].predicted, v) for i, v in duck.sql(f"SELECT doc_id, {label} FROM labels WHERE {label} IS NOT NULL").fetchall() if i in rows and rows[i].held_out]
    assert len(y) > 50 and np.mean([a == b for a, b in y]) >= 0.95
