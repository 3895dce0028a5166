"""The pipeline on the smallest tables, stage by stage."""

import random
import re
import string

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from graphie.llm import decontamination, jaccard_join
from graphie.llm.queries import ORACLES, QUERIES


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf).cache()
        counts.append(out.count())
        assert out.columns == (columns if i < 4 else [*columns, "copies"])
        docs = out
        if i == 1:
            found = jaccard_join.jaccard_components(out)
            assert found.filter("doc_id != component_id").count() == 0
        if i == 2:
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert decontamination.contaminated(out, bench).count() == 0
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] and counts[5] > 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def prose(rng, n):
    return ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(4, 8))) for _ in range(n)]


def kept_by_brute_force(texts, gram, part, whole):
    """The smallest id of each component of documents whose word n-gram sets overlap by part / whole."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets.append(set(zip(*(w[i:] for i in range(gram)))) if len(w) >= gram else {tuple(w)} if w else set())
    of = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and whole * len(a & sets[j]) >= part * len(a | sets[j]) and of[i] != of[j]:
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    return {i for i, low in enumerate(of) if i == low}


def test_near_copies_are_met_at_five_words_and_four_fifths(spark):
    rng = random.Random(11)
    texts = ["", "a b c d", "A b  c d", "a b c d e", "a b c d e f"]
    for _ in range(6):
        base = prose(rng, 145)
        for changes in (0, 1, 2, 3, 3, 4):
            w = list(base)
            for i in range(changes):
                w[20 + 30 * i] = prose(rng, 1)[0]
            texts.append(" ".join(w))
    for size in (30, 90, 260):
        base = prose(rng, size)
        for _ in range(15):
            w = base[: rng.randint(int(size * 0.8), size)]
            for _ in range(rng.randint(0, max(1, size // 40))):
                w[rng.randrange(len(w))] = prose(rng, 1)[0]
            texts.append(" ".join(w))
    order = rng.sample(range(len(texts)), len(texts))
    texts = [texts[i] for i in order]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"] for r in pipeline.drop_near_copies(spark, docs, "").collect()}
    want = kept_by_brute_force(texts, 5, 80, 100)
    assert got == want and want != kept_by_brute_force(texts, 4, 85, 100)


def test_stages_take_odd_rows_and_foreign_columns(spark, sf):
    some = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(10_001, None, "fr", None, None), (10_002, "", None, "s", 0), (10_003, " \t", None, "s", 2), (None, "no id at all", "en", "s", 12)], some.schema)
    names = ["score", "toxic_spans", "_text", "a.b", "_doc", "_found", "_plan_doc_id", "_key", "entities", "copies", "other_column_3"]
    docs = some.unionByName(odd).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)]).cache()
    for table in (docs, docs.limit(0)):
        for i, (name, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, table, sf)
            want = docs.columns if i < 4 else [c for c in docs.columns if c != "copies"] + ["copies"]
            assert out.columns == want, name
            rows = out.collect()
            assert bool(rows) == (table is docs)
            assert all(r[n] == k for r in rows for k, n in enumerate(names) if n != "copies" or i < 4)
            if table is docs and i < 4:
                assert {10_001, 10_002, 10_003, None} <= {r["doc_id"] for r in rows}, name
