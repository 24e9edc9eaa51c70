"""The pipeline's stages, each on what the one before kept, against brute force."""

import random

import corpus_pipeline as pipeline
from noteql.llm import line_dedup, mixing, simhash
from pyspark.sql import functions as F
from test_llm import DOCS, without_near_lines, words


def corpus(spark):
    rnd = random.Random(1)
    kinds = {"en": "the and with house ing water think", "de": "der und nicht schön haus wasser denken"}
    rows = []
    for i in range(160):
        lang = list(kinds)[i % 2]
        text = "\n".join(" ".join(rnd.choices(kinds[lang].split(), k=30)) + f" {words(rnd, 12, 10**6)}" for _ in range(3))
        rows.append((i, text, lang, f"src{i % 4}", len(text)))
    rows += [(200, rows[3][1], "de", "src1", 1), (201, "123 456", "en", "src0", 7), (202, None, None, None, None), (203, "", "en", "src0", 0)]
    near = rows[5][1].replace("wasser", "wasser!", 1)
    rows.append((204, near, "de", "src0", len(near)))
    return spark.createDataFrame(rows, DOCS), {r[0]: r[1] for r in rows}


def test_stages(spark):
    docs, texts = corpus(spark)
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "mixing", "bpe"]
    kept = pipeline.language_stage(spark, docs, "").cache()
    assert kept.columns == pipeline.COLUMNS
    assert {r.doc_id for r in kept.collect()} == set(texts) - {201, 202, 203}
    lined = pipeline.line_stage(spark, kept, "").cache()
    want = without_near_lines([(r.doc_id, r.text) for r in kept.collect()])
    got = {r.doc_id: (r.text, r.n_chars) for r in lined.collect()}
    assert got == {i: (t, len(t)) for i, t in want.items() if t.strip()} and 200 not in got and 0 in got
    deduped = pipeline.near_stage(spark, lined, "").cache()
    comp = {r.doc_id: r.component_id for r in simhash.near_duplicates(lined).collect()}
    assert {r.doc_id for r in deduped.collect()} == set(comp.values())
    mixed = pipeline.mixing_stage(spark, deduped, "").cache()
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(deduped).collect()}
    have: dict = {}
    for r in mixed.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + len(r.text.encode().split())
        assert deduped.where(F.col("doc_id") == r.doc_id).first().text.startswith(r.text) if len(have) < 4 else True
    assert have == {i: n for i, n in taken.items() if n}
    tokens = pipeline.token_stage(spark, mixed, "")
    assert tokens.count() == mixed.count() and tokens.where("n_tokens <> size(ids)").count() == 0


def test_run(spark, tmp_path):
    corpus(spark)[0].write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() > 100
    assert line_dedup.THRESHOLD == 0.8


def test_stages_on_awkward_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with clashing names, an empty table."""
    docs, _ = corpus(spark)
    rnd = random.Random(2)
    some = [tuple(r) for r in docs.limit(40).collect()]
    long = "\n".join(words(rnd, 900, 40) for _ in range(60))
    rows = some + some[:3] + [(900, long, "en", "src1", 5), (None, some[4][1], "en", None, None), (None, "alone und mit keinem anderen text zu vergleichen", "de", "src0", 3), (901, None, None, None, None), (902, "", "en", "src0", 0), (903, "\n \n", "en", None, 3)]
    awkward = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("score", "size", "fp", "row", "kept", "shard", "kind", "component_id", "lang_pred", "pass")})
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, awkward, "")
        found = [tuple(r) for r in (out.select(pipeline.COLUMNS) if k < 4 else out.select("doc_id", "n_tokens")).collect()]
        assert k == 4 or out.columns == pipeline.COLUMNS
        ids = [r[0] for r in found]
        if name == "language_id":
            assert len(found) == len(rows) - 3 and {901, 902, 903} & set(ids) == set()
        if name == "line_dedup":
            assert ids.count(some[0][0]) == 2 and 901 in ids and 902 in ids
        if name == "near_dedup":
            texts = [r[1] for r in found if r[0] is None]
            assert texts == ["alone und mit keinem anderen text zu vergleichen"] and ids.count(some[0][0]) == 2 and len({901, 902, 903} & set(ids)) == 1
        if name == "mixing":
            assert 901 not in ids and 902 not in ids and 900 in ids
        if name == "bpe":
            assert len(found) == len(rows) and (901, 0) in found and (902, 0) in found
        assert stage(spark, awkward.limit(0), "").count() == 0
