"""The pipeline's rows against a version without Spark."""

import collections

import pytest

from gridloom.llm import decontamination, language_id, line_dedup
from pyspark.sql import functions as F
from test_operators import CLASHES, brute_components, prose, shingle_sets  # noqa: E402

pipeline = pytest.importorskip("corpus_pipeline")


def build(spark, folder):
    item = "Where does the river run dry? It runs dry below the old mill at the end of every long summer."
    line = prose(900, 30) + "."
    rows = [(i, prose(i, 60 + i % 40) + ("\n" + line if i % 9 == 0 else ""), "en" if i % 2 else "de", f"s{i % 4}") for i in range(60)]
    rows += [(60 + i, rows[i][1], rows[i][2], "s1") for i in range(5)] + [(70, prose(7, 67).replace(" ", " ", 1) + " tail", "en", "s0"), (71, prose(500, 80) + " " + item, "en", "s2"), (72, "12 34 !!", "en", "s2"), (73, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    bench = [(0, item), (1, prose(990, 30))]
    spark.createDataFrame(bench, "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return docs, bench


def test_pipeline(spark, tmp_path):
    docs, bench = build(spark, str(tmp_path))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    model = language_id.train(language_id.eligible(docs))
    names, scores = model.predict([t for _, t, _ in rows])
    rows = [r for r, n, s in zip(rows, names, scores, strict=True) if n != "und" and s >= 0.5]
    sets = [shingle_sets(t) for _, t, _ in rows]
    label = brute_components(list(range(len(rows))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    first: dict = {}
    for k, (i, _, _) in enumerate(rows):
        first[label[k]] = min(first.get(label[k], i), i)
    rows = [r for k, r in enumerate(rows) if first[label[k]] == r[0]]
    seen, cut = set(), []
    for i, t, s in sorted(rows):
        gone = [False] * len(t)
        for _, a, b, piece in line_dedup.units(t, "sentence", line_dedup.MIN_WORDS):
            if piece in seen:
                gone[a:b] = [True] * (b - a)
            seen.add(piece)
        out = ""
        for k, c in enumerate(t):
            if not gone[k]:
                out += c
            elif c == "\n" and (k + 1 == len(t) or not gone[k + 1]):  # a break stays, unless a whole line went
                begin = k
                while begin and gone[begin - 1]:
                    begin -= 1
                out += "\n" if begin and t[begin - 1] != "\n" else ""
        cut.append((i, out, s))
    rows = [r for r in cut if r[1].strip(" ")]
    every = [(j, decontamination.halves(x)) for j, x in bench]

    def leaks(t):
        w = decontamination.words(t)
        hold = lambda h: decontamination.shingles(h) <= decontamination.shingles(w)
        return any(hold(q) and hold(a) for _, (q, a) in every)

    rows = [r for r in rows if not leaks(r[1])]
    got = pipeline.run(spark, str(tmp_path))
    found = {r.doc_id: r for r in got.collect()}
    totals = collections.Counter()
    for _, t, s in rows:
        totals[s] += len(t.encode().split())
    assert all(found[i].text == t and found[i].n_chars == len(t) for i, t, _ in rows if i in found)
    assert set(found) <= {i for i, _, _ in rows} and all(r.taken > 0 for r in found.values())
    taken = collections.Counter()
    for r in found.values():
        taken[r.source] += r.taken
        assert r.source_size == totals[r.source]
    assert {s: round(v) for s, v in {r.source: r.target for r in found.values()}.items()} == dict(taken)
    assert 71 not in found and 72 not in found and 73 not in found and not {60, 61, 62, 63, 64} & set(found)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    docs, _ = build(spark, str(tmp_path))
    text = prose(4321, 300)
    odd = [(None, text, None, None, None), (None, text, None, None, None), (None, None, "en", "s1", 3), (500, "", None, "s1", None), (501, "a" * 1_500_000, "en", "s1", 1), (502, ". " * 400_000, "en", "s1", 1), (503, "word " * 300_000, "en", None, 1), (7, text, "en", "s1", 1), (504, "\ud55c\uad6d\uc5b4 " * 50, "ko", "", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    docs = docs.select("*", *[F.lit(f"{c}!").alias(c) for c in CLASHES])
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        kept = stage(spark, docs, str(tmp_path))
        own = kept.columns[: len(docs.columns)]
        assert own == docs.columns and (name == "source_mixing" or kept.columns == own), name
        rows = kept.collect()
        assert len(rows) > 40 and all(r[c] == f"{c}!" for r in rows for c in CLASHES), name
        if name != "substring_dedup":
            texts = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
            assert all((r.doc_id, r.text) in texts for r in rows), name
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    assert kept.columns[len(docs.columns) :] == ["mix_size", "mix_source_size", "mix_target", "mix_mix_taken"]
