"""The pipeline on planted cases: each stage takes what it should and leaves the rest alone."""

import os
import random

import pytest

import __spark_entry__ as registered
import corpus_pipeline
from tests import compare

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the generated tables")


def test_planted_cases(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("bdgklmnprst", k=2)[0] + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(n))
    texts = {i: prose(rng.randint(4, 9)) for i in range(120)}
    clean = set(texts)
    bench = " ".join(word() for _ in range(25))
    passage = " ".join(word() for _ in range(70))
    texts |= {200 + i: " ".join(w.upper() + "!!" for w in prose(5).split()) for i in range(40)}
    texts |= {300 + i: texts[i] for i in range(5)}  # exact copies
    texts |= {320 + i: f"{prose(3)}\n{passage}" for i in range(6)}
    texts |= {340 + i: f"{prose(3)} {bench} {prose(2)}" for i in range(3)}
    one_line = {i: prose(30).replace("\n", " ") for i in range(360, 364)}
    texts |= one_line | {i + 10: " ".join(t.split()[:-1] + ["zzz"]) for i, t in one_line.items()}  # near copies
    rows = [(i, t, "xx", f"s{i % 5}", len(t)) for i, t in texts.items()] + [(900, None, None, None, None), (901, "", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 200 <= i < 240)) for i in texts if i % 2 or i > 300], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{n}")
        docs = spark.read.parquet(f"{tmp_path}/out{n}")
        assert docs.columns == columns or n == len(corpus_pipeline.STAGES) - 1, name
        kept.append({r[0]: r for r in docs.collect()})
    after = [set(k) for k in kept]
    assert clean <= after[0] and [i for i in after[0] if 200 <= i < 240] == []
    assert clean <= after[1] and not any(300 <= i < 305 for i in after[1])
    assert passage in kept[1][320].text and not any(passage in kept[1][i].text for i in range(321, 326))
    assert all(kept[1][i].n_chars == len(kept[1][i].text) for i in range(321, 326))
    assert clean <= after[2] and set(one_line) <= after[2] and not any(i + 10 in after[2] for i in one_line)
    assert after[3] == after[2] - {340, 341, 342}
    assert after[4] == after[3] and all(len(r.ids) == r.n_tokens for r in kept[4].values())


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in registered.queries() if n.startswith("op")))
def test_query(spark, name):
    """Equal to its SQL where there is any, else a row per input row."""
    rows, only_spark, only_sql, unequal_types, *_ = compare.check(spark, SF_DIR, name)
    assert rows and (only_spark[:3], only_sql[:3], unequal_types) == ([], [], [])
