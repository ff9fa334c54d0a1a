"""The pipeline's stages on a small input, each against what its operator decides."""

import corpus_pipeline as P
from quarry.llm import decontaminate, language_id, near_dedup, pii, source_mix

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontaminate", "pii", "source_mix"]
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF).cache()
        seen[name] = (docs, out)
        if name != "source_mix":
            assert out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
        docs = out
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    a, b = seen["language_id"]
    assert ids(b) == ids(language_id.language_id(a).where("not rejected"))
    a, b = seen["near_dedup"]
    assert ids(b) == ids(near_dedup.near_dedup(a).where("kept")) and b.count() == len(ids(b))
    a, b = seen["decontaminate"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids(b) == ids(decontaminate.decontaminate(a, bench).where("not contaminated"))
    assert decontaminate.decontaminate(b, bench).where("contaminated").count() == 0
    a, b = seen["pii"]
    assert ids(b) == ids(a) and pii.pii(b).where("spans <> ''").count() == 0
    a, b = seen["source_mix"]
    assert ids(b) == ids(source_mix.source_mix(a).where("taken > 0")) and b.where("copies < 1 or copies > 3").count() == 0


def test_run(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies"] and out.count() > 50


def _through(spark, docs, folder):
    for k, (_, stage) in enumerate(P.STAGES):
        names = docs.columns
        docs = stage(spark, docs, folder)
        if k < len(P.STAGES) - 1:
            assert docs.columns == names
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score string, rejected int, lang_pred string, copies int, k1 string, hits int, w string, t int, base int, spans string, label int, cid int, size int, taken int, _c0 int, _row int"


def test_awkward_rows_and_names(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns through all five stages."""
    real = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    awkward = [(9001, None, None, None), (9002, "", "en", "src1"), (9003, " \n ", "en", None), (None, real[1][1] + " and some more words here", "en", "src1"), (9004, "!!! 123", None, "src2"), (9005, "word " * 60_000 + real[0][1], "en", "src3")]
    rows = [(*r, len(r[1] or ""), "s", 1, "p", 7, "k", 2, "w", 3, 4, "x", 5, 6, 8, 9, 10, 11) for r in [*real, *awkward, *real[:20]]]
    docs = spark.createDataFrame(rows, CLASH)
    spark.createDataFrame([(1, "some benchmark item of a few words that no document holds at all"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = _through(spark, docs, str(tmp_path)).cache()
    assert out.columns == [*docs.columns, "mix_copies"] and out.count() > 50
    assert {tuple(r)[4:] for r in out.select(*docs.columns).drop("n_chars").distinct().collect()} == {("s", 1, "p", 7, "k", 2, "w", 3, 4, "x", 5, 6, 8, 9, 10, 11)}
    assert out.where("n_chars <> length(text)").count() == 0 and not {r["doc_id"] for r in out.collect()} & {9001, 9002, 9003, 9004}
    assert out.groupBy("doc_id").count().where("count > 1").count() == 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none = spark.createDataFrame([], CLASH)
    assert _through(spark, none, str(tmp_path)).count() == 0
    unlabelled = spark.createDataFrame([(1, "no language is known here", None, "a")], "doc_id long, text string, lang string, source string")
    assert P.stage_language(spark, unlabelled, "").count() == 0


def test_near_dedup_stage_links_from_80_per_cent(spark):
    texts = {}
    for group in range(24):
        n, changed = [(45, 1), (90, 2), (296, 6), (296, 5), (296, 7), (46, 1)][group % 6]
        words = [f"g{group}w{i}" for i in range(n + 4)]
        texts[2 * group] = list(words)
        for k in range(changed):
            words[10 + 12 * k] = f"other{k}"
        texts[2 * group + 1] = words
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    share = {i: 100 * len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 48, 2)}
    assert sum(80 <= x < 85 for x in share.values()) == 20 and 80.0 in share.values() and min(share.values()) < 80
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {r["doc_id"] for r in P.stage_near_dedup(spark, docs, SF).collect()}
    assert got == set(range(0, 48, 2)) | {i + 1 for i, x in share.items() if x < 80}
