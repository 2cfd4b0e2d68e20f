"""Quality rules, whitening and collocations: brute force, guarantees and odd input."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from percepta.llm import collocations, decontaminate, quality_rules, queries, secrets, whitening

DATA = "/root/testdata/sf0.01"
WORDS = [f"w{i}" for i in range(300)]


def said(seed, n=80):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def brute_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark):
    texts = [None, "", " \n\t", "a b c a b c a b", "x\nx\n\n \nx y\nx y", "É # ß|\x0bq", "one", "a a a a a", said(1, 30_000) + "\n" + said(1, 40) + "\n" + said(1, 40), "\r\n".join([said(2, 9)] * 5)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.m for r in df.select("doc_id", quality_rules.measured(df.text).alias("m")).collect()}
    assert [tuple(got[i][:5]) for i in range(len(texts))] == [brute_measures(t) for t in texts]


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, 100), (1, 300), (3, 900), (50, 5000), (90, 100)], "k long, n long")
    for r in df.select("k", "n", quality_rules.log_binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect():
        want = sum(math.comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1)) if r.k <= 0.02 * r.n else 1.0
        assert r.p == pytest.approx(math.log(want), abs=1e-9)


def labelled(spark, n=1200, noise=0):
    """Clean texts and symbol junk in language a; too few labels in b; noise clean texts of a hold junk as well."""
    rows, labels = [], []
    for i in range(n):
        junk = i % 4 == 0
        text = said(i, 60) + (" ###" * 40 if junk or i % 4 == 1 and i < 4 * noise else "")
        rows.append((i, text, "a" if i < n - 40 else "b", None))
        labels.append((i, int(not junk)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_cutoffs_reject_junk_and_keep_clean_documents(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in quality_rules.judge_documents(docs, labels).collect()}
    assert all(got[i].kept == (i % 4 != 0) for i in range(1160))
    assert all(r.kept for i, r in got.items() if i >= 1160)  # nothing is certified with 40 labels
    cut = {(r.stratum, r.rule) for r in quality_rules.describe(quality_rules.fit_cutoffs(docs.select("doc_id", docs.lang.alias("stratum"), quality_rules.measured(docs.text).alias("m")), labels)).collect()}
    assert ("a", "symbols") in cut and {s for s, _ in cut} == {"a"}
    kept = quality_rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 870 + 40


def test_a_rule_that_rejects_good_documents_is_not_certified(spark):
    docs, labels = labelled(spark, noise=60)
    assert all(r.kept for r in quality_rules.judge_documents(docs, labels).collect())


def test_quality_rules_with_odd_input(spark):
    docs, labels = labelled(spark, 8)
    assert all(r.kept for r in quality_rules.judge_documents(docs, labels.limit(0)).collect())
    assert quality_rules.judge_documents(docs.limit(0), labels).count() == 0
    odd = spark.createDataFrame([(None, said(1), None, "x"), (None, said(1), None, "x"), (1, None, "a", "y"), (1, "", "a", "y"), (2, " \n", None, None), (3, said(4, 50_000), "a", None)], docs.schema)
    none = spark.createDataFrame([(None, 1), (1, None), (1, 0), (1, 1), (99, 1)], labels.schema)
    got = quality_rules.judge_documents(odd, none).collect()
    assert sorted((r.n_words, r.kept) for r in got) == [(0, False)] * 3 + [(80, True)] * 2 + [(50_000, True)]


def brute_whitening(vectors, most=16):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    a = (n * fit - total) / n
    e, turn = np.linalg.eigh(a.T @ a / n)
    e, turn = e[::-1], turn[:, ::-1]
    k = min(most, int((e > 1e-12 * e[0]).sum()))
    return n, ((n * x - total) ** 2).sum(1), ((n * x - total) / n) @ turn[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def compared(rows, ids, vectors, most=16):
    n, deviation, want, share = brute_whitening(vectors, most)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(ids) * want.shape[1] == len(got)
    for k in range(want.shape[1]):
        w = np.array([got[i, k + 1].whitened for i in ids])
        assert min(np.abs(w - want[:, k]).max(), np.abs(w + want[:, k]).max()) < 1e-7
        assert got[ids[0], k + 1].explained == pytest.approx(share[k], rel=1e-9)
    for j, i in enumerate(ids):
        assert (got[i, 1].n, got[i, 1].deviation) == (n, deviation[j]) and got[i, 1].identity_error < 1e-9


def test_whitening_equals_brute_force(spark):
    rows = queries.op12_embedding_whitening(spark, DATA).collect()
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    compared(rows, [r.vec_id for r in table], [r.embedding for r in table])


@pytest.mark.parametrize("kind", ["steep", "flat", "few", "large"])
def test_whitening_of_hard_matrices(spark, kind):
    """Spreads from 1 to 10,000; constant and dependent entries; fewer vectors than entries; entries far from 0. Repeated rows everywhere."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((200, 12)) * np.logspace(4, 0, 12)
    if kind == "flat":
        v = rng.standard_normal((200, 12)) * np.linspace(9, 4, 12)
        v[:, 3], v[:, 7] = 2.5, np.floor(v[:, 1] * 64) / 64 * 2
        v[:, 1] = np.floor(v[:, 1] * 64) / 64
    v = v[:6] if kind == "few" else v * 1e6 + 1e9 if kind == "large" else v
    v = np.concatenate([v, v[:3], v[:1]])
    df = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    if kind == "large":
        rows = whitening.whitened_components(df).collect()
        x = [[int(math.floor(64 * float(c))) + 1_000_000 for c in row] for row in v]
        fit = {tuple(r) for r in x}
        total = [sum(c) for c in zip(*fit, strict=True)]
        want = [sum((len(fit) * a - s) ** 2 for a, s in zip(r, total, strict=True)) for r in x]
        assert {r.vec_id: r.deviation for r in rows} == {i: w if w < 2**63 else None for i, w in enumerate(want)}
        assert rows[0].identity_error < 1e-6
    else:
        compared(whitening.whitened_components(df).collect(), list(range(len(v))), v)


def test_whitening_of_odd_input(spark):
    schema = "vec_id long, embedding array<float>, whitened string, `a b` int"
    rows = [(1, [1.0, 2.0], "x", 1), (1, [1.0, 2.0], "x", 1), (None, [0.0, 0.0], "x", 1), (2, [3.0, 1.0], None, 1), (3, None, "x", 1), (4, [], "x", 1), (5, [1.0, None], "x", 1), (6, [float("nan"), 1.0], "x", 1), (7, [float("inf"), 1.0], "x", 1), (8, [1.0], "x", 1), (9, [1e30, 1.0], "x", 1)]
    got = whitening.whitened_components(spark.createDataFrame(rows, schema)).collect()
    assert Counter(r.vec_id for r in got) == {1: 4, None: 2, 2: 2} and {r.n for r in got} == {3}
    found, model = whitening.whiten(spark.createDataFrame(rows, schema))
    assert found.columns == ["row", "deviation", "whitened"] and found.count() == 4 and model.passes >= 1
    same = spark.createDataFrame(rows[:2], schema)
    assert [r.deviation for r in whitening.whiten(same)[0].collect()] == [0, 0] and whitening.whitened_components(same).count() == 0
    assert whitening.whitened_components(same.limit(0)).count() == 0


def brute_collocations(docs, least):
    n, f = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in found.items():
        lang, *w = p
        score, cut = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
        if not any(q[0] == lang and len(q) > len(p) and b == a and any(q[i : i + len(w)] == tuple(w) for i in range(1, len(q))) for q, b in found.items()):
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:cut]], f[lang, *w[cut:]], n[lang]))
    return {(lang, k + 1, p.decode(), -a, left, right, m, -s) for lang, rows in out.items() for k, (s, a, p, left, right, m) in enumerate(sorted(rows))}


@pytest.mark.parametrize("options", [{}, {"most_words": 0}, {"most_words": 6}])
def test_collocations_equal_brute_force(spark, options):
    """With frequent words and pairs, with all words, and with frequent words where the pairs are too many."""
    rng = np.random.default_rng(3)
    vocabulary = ["The", "cat", "Sat", "on", "é", "#x", "\x0ba", "ÄB"][: 5 if options.get("most_words") == 6 else 8]
    docs = [("en" if i % 3 else None, "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", " ", ". ", "\n", "?!"], p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05]) for _ in range(60))) for i in range(40)]
    docs += [("und", None), ("und", ""), (None, " ,. "), ("de", "einmal nur"), ("en", "x " * 4000 + "long tail"), ("en", docs[1][1]), ("en", docs[1][1])]
    df = spark.createDataFrame([(i, t, la, 1) for i, (la, t) in enumerate(docs)], "doc_id long, text string, lang string, rank int").repartition(3)
    got = {tuple(r) for r in collocations.collocations(df, least=9, **options).collect()}
    assert got == brute_collocations(docs, 9) and len(got) > 20


def test_collocations_of_odd_input(spark):
    df = spark.createDataFrame([(1, "a b a b", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(df.limit(0)).count() == 0 and collocations.collocations(df).count() == 0
    one = collocations.collocations(df, least=2).collect()
    assert [(r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in one] == [(1, "a b", 2, 2, 2, 4, 2000)]
    top = collocations.collocations(df, least=1, top=1).collect()
    assert len(top) == 1


def test_passages_with_moved_parts_are_found(spark):
    """Halves, thirds and quarters of an item in another order, words put in at both ends: all windows are compared by brute force."""
    rng = np.random.default_rng(7)
    vocabulary = [f"v{i}" for i in range(5000)]
    items, docs, want = [], [], set()
    for i in range(20):
        item = list(rng.choice(vocabulary, 60))
        items.append((i, " ".join(item)))
        for parts in (1, 2, 3):
            cut = [item[k * 60 // parts : (k + 1) * 60 // parts] for k in range(parts)][::-1]
            body = [w for part in cut for w in part]
            text = [*rng.choice(vocabulary, rng.integers(0, 90)), *body, *rng.choice(vocabulary, rng.integers(0, 90))]
            docs.append((len(docs), " ".join(text)))
            own, grams = Counter(tuple(item[j : j + 5]) for j in range(56)), [tuple(text[j : j + 5]) for j in range(len(text) - 4)]
            for at in range(len(text) - 59):
                c = Counter(grams[at : at + 56])
                if sum((c & own).values()) / sum((c | own).values()) >= 0.8:
                    want.add((len(docs) - 1, i))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == want and all((3 * i, i) in got and (3 * i + 1, i) in got for i in range(20))


def test_many_spans_in_one_text(spark):
    """Twice the spans take about twice the time, and all are there."""
    import time

    def run(n):
        text = " ".join(f"{i:016x}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        row = secrets.find_secrets(df).select("n_hex", "base").first()
        assert row.n_hex == n and row.base.endswith(f"hex:{17 * (n - 1)}:{17 * n - 1}")
        return time.time() - began

    run(300)
    half, whole = run(32_000), run(64_000)
    assert whole < 3 * half + 2 and whole < 30


def test_windows_end_at_rare_pairs_however_many_pairs_are_frequent(spark, monkeypatch):
    """op13: with more frequent pairs than are sent as they are, bits of their hashes end the windows; the result stays the same."""
    import numpy as np
    from percepta.llm import collocations

    rng = np.random.default_rng(8)
    said = [" ".join(f"w{i}" for i in rng.integers(0, 40, 60)) + ". red apple pie now" for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en" if i % 3 else None) for i, t in enumerate(said)], "doc_id long, text string, lang string").repartition(3)
    made, counts = [], collocations.phrase_counts
    monkeypatch.setattr(collocations, "phrase_counts", lambda w, width, *a: made.append((width, w.count())) or counts(w, width, *a))

    def run(**options):
        made.clear()
        return sorted(map(tuple, collocations.collocations(df, 4, 5, 2000, **options).collect())), dict(made)[5]

    exact, rows = run()
    # 88 frequent words of the two languages, and far more pairs.
    got, with_bits = run(most_words=100)
    monkeypatch.setattr(collocations, "_bits", lambda pairs: np.full(1 << 12, 255, np.uint8))
    same, unpruned = run(most_words=100)
    assert got == same == exact and len(exact) > 20 and rows <= with_bits < 1.2 * rows < unpruned / 2
