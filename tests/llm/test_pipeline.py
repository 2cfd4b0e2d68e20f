"""The pipeline, stage by stage, against plain Python over the same documents."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from percepta.llm import toxicity

from test_queries import components, shingles

WORDS = [f"word{i}" for i in range(600)]
BAD = [f"vile{i}" for i in range(12)]


def made(spark, folder):
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(rng.choice(WORDS, n))
    items = [(i, say(30)) for i in range(20)]
    rows, labels = [], []
    for i in range(300):
        text = "\n".join([say(25), say(25), f"Footer of site {i % 3}"])
        toxic = i % 6 == 0
        if toxic:
            text += " " + " ".join(rng.choice(BAD, 12))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    for i in range(40):  # near copies of clean documents
        w = rows[6 * i + 1][1].split(" ")
        w[3] = f"other{i}"
        rows.append((1000 + i, " ".join(w), "en", rows[6 * i + 1][3], 0))
    for i in range(20):  # passages of the benchmark
        rows.append((2000 + i, f"{say(40)} {items[i][1].upper()} {say(20)}", "en", "s4", 0))
    rows += [(3000, None, "en", None, None), (3001, "", None, "s0", 0), (3001, "", None, "s0", 0), (None, say(50), "en", "s1", 0), (None, say(50), "en", "s1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    return folder, *made(spark, folder)


def test_stages_equal_brute_force(spark, world):
    folder, rows, items = world
    docs, by_name = spark.read.parquet(f"{folder}/documents.parquet"), dict(corpus_pipeline.STAGES)

    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    table = model.table()
    clean = [r for r in rows if model.score(*toxicity._found(r[1], table)) < 0.5]
    one = by_name["toxicity"](spark, docs, folder)
    assert as_rows(one) == sorted(clean, key=repr)
    assert {r[0] for r in clean} == {r[0] for r in rows if not (r[0] is not None and r[0] < 300 and r[0] % 6 == 0)}

    pages = {}
    for r in clean:
        if r[1] is not None:
            pages.setdefault(r[3], set()).add(r[1])
    held = {s: Counter(x for t in texts for x in {x.strip(" \t\r\x0b\x0c") for x in t.split("\n")} - {""}) for s, texts in pages.items()}
    boiler = {s: {x for x, n in c.items() if n >= 2 and n > 0.1 * len(pages[s])} for s, c in held.items()}

    def cut(r):
        lines = None if r[1] is None else r[1].split("\n")
        left = lines and [x for x in lines if x.strip(" \t\r\x0b\x0c") not in boiler.get(r[3], ())]
        return r if not lines or len(left) == len(lines) else (*r[:1], "\n".join(left), *r[2:4], len("\n".join(left)))

    trimmed = [cut(r) for r in clean]
    two = by_name["line_dedup"](spark, one, folder)
    assert as_rows(two) == sorted(trimmed, key=repr) and not any("Footer" in (r[1] or "") for r in trimmed if r[3] != "s4")

    sets = {k: shingles(r[1], 5) for k, r in enumerate(sorted(trimmed, key=lambda r: (r[0] is not None, r[0] or 0)))}
    order = sorted(trimmed, key=lambda r: (r[0] is not None, r[0] or 0))
    groups = components({k: s for k, s in sets.items() if s})
    single = [r for k, r in enumerate(order) if not sets[k] or groups[k] == k]
    three = by_name["minhash_near_dedup"](spark, two, folder)
    assert as_rows(three) == sorted(single, key=repr) and len(trimmed) - len(single) == 40

    bad = [" ".join(re.findall(r"\S+", t.lower())) for _, t in items]
    pure = [r for r in single if not any(b in " ".join((r[1] or "").lower().split()) for b in bad)]
    four = by_name["decontamination"](spark, three, folder)
    assert as_rows(four) == sorted(pure, key=repr) and len(single) - len(pure) == 20

    five = by_name["mix_sources"](spark, four, folder).collect()
    size = lambda r: len((r[1] or "").split())
    assert sorted(((r.doc_id, r.size) for r in five), key=repr) == sorted(((r[0], size(r)) for r in pure), key=repr)
    totals = Counter()
    for r in pure:
        totals[r[3]] += size(r)
    taken = Counter()
    for r in five:
        assert 0 <= r.taken <= 2 * r.size and totals[r.source_size] == 0
        taken[r.source_size, r.target] += r.taken
    assert sum(t for _, t in taken) == pytest.approx(min(1.5, 2.0) * sum(totals.values()))
    assert all(abs(n - target) <= 60 for (_, target), n in taken.items())
    again = corpus_pipeline.run(spark, folder)
    assert as_rows(again) == sorted(map(tuple, five), key=repr)


def test_stages_keep_extra_columns_and_empty_tables(spark, world):
    folder, *_ = world
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    names = ["row", "t1", "bad", "tk", "d", "no", "said", "salt", "common", "left", "score", "group", "s", "none", "at"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide = docs.selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
        got = stage(spark, wide, folder)
        assert got.columns == wide.columns, name
        assert all(r[n] == n for r in got.collect() for n in names), name
        assert stage(spark, docs.limit(0), folder).count() == 0


