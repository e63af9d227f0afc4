import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reviewlake.lexicons import NO_TRANSLATION_NEGATIVE
from reviewlake.operators import language, translate


@pytest.mark.parametrize(
    "text, hits, english",
    [
        ("the staff was nice", 3, True),
        ("the view", 1, False),
        ("clean room", 0, False),
        ("ok", 0, True),
        (None, None, True),
    ],
)
def test_english_shortcut(spark, text, hits, english):
    row = spark.createDataFrame([(text,)], "t string").select(
        language.pattern_hits(F.col("t")), language.english_shortcut(F.col("t"))
    )
    assert tuple(row.first()) == (hits, english)


TRAIN = [
    ("en", "the cat and the dog went to the house with the other cats"),
    ("de", "der hund und die katze gehen nicht in das haus und schlafen"),
    ("fr", "le chat et le chien ne vont pas dans la maison avec les autres"),
]


def trigrams(text):
    padded = " " + re.sub(r"[^a-z]+", " ", text.lower()) + " "
    return [padded[i - 1 : i + 2] for i in range(1, len(padded) - 1) if padded[i] != " "]


def brute_detect(texts, size):
    counts = defaultdict(Counter)
    for lang, text in TRAIN:
        counts[lang].update(trigrams(text))
    distinct = len({t for c in counts.values() for t in c})
    out = {}
    for key, text in texts:
        grams, best = trigrams(text), []
        for lang, c in counts.items():
            profile = dict(sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:size])
            floor = round(-math.log(sum(c.values()) + distinct) * 1e6)
            gain = sum(round(math.log(profile[g] + 1) * 1e6) for g in grams if g in profile)
            if gain:
                best.append((-(gain + len(grams) * floor), lang))
        out[key] = min(best)[1] if best and len(text.strip()) > 3 else "en"
    return out


def profiles(spark, size=None):
    return language.fit_language_profiles(
        spark.createDataFrame(TRAIN, "lang string, text string"), "text", "lang", size
    )


def test_detection_equals_brute_force(spark):
    texts = [(1, "the house"), (2, "die katze im haus"), (3, "le chien dans la maison"), (4, "xyzq"),
             (5, "et"), (6, "une grande maison 12"), (7, "das"), (8, "")]
    rows = spark.createDataFrame(texts, "id long, text string")
    for size in (5, 50):
        got = language.detect_language(rows, "id", "text", profiles(spark, size))
        assert {r["id"]: r["lang"] for r in got.collect()} == brute_detect(texts, size)


def test_scores_do_not_depend_on_partitioning(spark):
    texts = [(i, TRAIN[i % 3][1] * (1 + i % 4)) for i in range(60)]
    rows = spark.createDataFrame(texts, "id long, text string")
    fitted = profiles(spark)
    assert fitted.count() > 50
    one, many = (
        {tuple(r) for r in language.detect_language(rows.repartition(n), "id", "text", fitted).collect()}
        for n in (1, 13)
    )
    assert one == many


def test_many_languages_are_scored_as_rows(spark, monkeypatch):
    texts = [(1, "the house"), (2, "die katze im haus"), (3, "le chien dans la maison"), (4, "xyzq"), (5, "et"), (6, "")]
    rows = spark.createDataFrame(texts, "id long, text string")
    monkeypatch.setattr(language, "MAX_LANGUAGE_COLUMNS", 1)
    got = language.detect_language(rows, "id", "text", profiles(spark, None))
    assert {r["id"]: r["lang"] for r in got.collect()} == brute_detect(texts, None)


def test_tag_uses_shortcut_first(spark):
    rows = spark.createDataFrame(
        [(1, "this was good and the chat"), (2, "le chien dans la maison"), (3, "no")], "id long, text string"
    )
    got = language.tag_language(rows, "id", "text", profiles(spark))
    assert {r["id"]: r["lang"] for r in got.collect()} == {1: "en", 2: "fr", 3: "en"}


ROWS = [
    (1, "fr", "bonjour tout"), (2, "fr", "bonjour tout"), (3, "en", "hello there"), (4, "fr", " N/A "),
    (5, "de", "guten tag"), (6, "fr", None), (7, "fr", "oui"), (8, "de", "bonjour tout"), (9, None, "texte"),
]


def reviews(spark):
    return spark.createDataFrame(ROWS, "id long, lang string, t string")


def test_translation_through_memory(spark):
    memory = spark.createDataFrame(
        [("fr", "bonjour tout", "hello all"), ("fr", "unused text", "x")],
        "lang string, text string, translated string",
    )
    out = translate.apply_memory(reviews(spark), "id", "t", "lang", memory, NO_TRANSLATION_NEGATIVE, "e")
    got = {r["id"]: r["e"] for r in out.collect()}
    assert got == {1: "hello all", 2: "hello all", 3: "hello there", 4: " N/A ", 5: "guten tag",
                   6: None, 7: "oui", 8: "bonjour tout", 9: "texte"}


def test_translator_sees_each_missing_text_once(spark):
    def translator(texts, langs):
        assert len(texts) == len(langs) and len(set(zip(texts, langs))) == len(texts)
        return [None if t == "guten tag" else f"{lang}:{t}" for t, lang in zip(texts, langs)]

    wanted = translate.translation_candidates(reviews(spark), "t", "lang", NO_TRANSLATION_NEGATIVE)
    assert wanted.count() == 3
    empty = spark.createDataFrame([], "lang string, text string, translated string")
    fresh = translate.run_translator(translate.memory_misses(wanted, empty), translator, batch=2)
    assert {tuple(r) for r in fresh.collect()} == {
        ("fr", "bonjour tout", "fr:bonjour tout"), ("de", "bonjour tout", "de:bonjour tout"),
    }
    left = translate.memory_misses(wanted, fresh)
    assert [tuple(r) for r in left.collect()] == [("de", "guten tag")]


def test_hit_rate_and_coverage(spark):
    got = translate.memory_hit_rate(reviews(spark).where("t IS NOT NULL AND lang IS NOT NULL"), "lang", "t")
    row = got.first()
    assert (row["lookups"], row["misses"], row["hits"]) == (7, 6, 1)
    assert row["hit_rate"] == pytest.approx(100 / 7)
    assert translate.memory_hit_rate(reviews(spark).limit(0), "lang", "t").first()["hit_rate"] == 0.0
    assert translate.translation_coverage(reviews(spark), "t").first()["with_translation"] == 8


def test_repeated_memory_rows_do_not_multiply_reviews(spark):
    memory = spark.createDataFrame(
        [("fr", "bonjour tout", "b"), ("fr", "bonjour tout", "a"), ("de", "guten tag", "good day")],
        "lang string, text string, translated string",
    )
    out = translate.apply_memory(reviews(spark), "id", "t", "lang", memory, NO_TRANSLATION_NEGATIVE, "e")
    got = sorted((r["id"], r["e"]) for r in out.collect())
    assert len(got) == len(ROWS) and dict(got)[1] == "a" and dict(got)[5] == "good day"


def test_two_sides_take_one_scan_and_one_join(spark, tmp_path):
    rows = [(1, "bonjour tout", "fr", "hello", "en", 5), (2, None, None, "guten tag", "de", 6), (3, "oui", "fr", "bonjour tout", "fr", 7)]
    spark.createDataFrame(rows, "id long, n string, n_lang string, p string, p_lang string, extra int").write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("fr", "bonjour tout", "hi all"), ("de", "guten tag", "good day")],
                          "lang string, text string, translated string").write.parquet(f"{tmp_path}/memory")
    df, memory = spark.read.parquet(f"{tmp_path}/in"), spark.read.parquet(f"{tmp_path}/memory")
    out = translate.apply_memory_to_sides(df, "id", {"n": NO_TRANSLATION_NEGATIVE, "p": ["hello"]}, memory)
    assert out.columns == [*df.columns, "n_translated", "p_translated"]
    got = {r["id"]: (r["n_translated"], r["p_translated"], r["extra"]) for r in out.collect()}
    assert got == {1: ("hi all", "hello", 5), 2: (None, "good day", 6), 3: ("oui", "hi all", 7)}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan parquet") == 2 and plan.count("Join") == 1
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_three_sides_come_together_without_aggregating_rows(spark, tmp_path):
    rows = [(i, f"text {i}", "fr", None, None, f"text {i % 3}", "fr", i * 2) for i in range(50)]
    schema = "id long, a string, a_lang string, b string, b_lang string, c string, c_lang string, extra int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    memory = spark.createDataFrame([("fr", "text 1", "z"), ("fr", "text 1", "y"), ("fr", "text 1", None)],
                                   "lang string, text string, translated string")
    df = spark.read.parquet(f"{tmp_path}/in")
    for frame in (df, df.limit(0)):
        out = translate.apply_memory_to_sides(frame, "id", {"a": [], "b": [], "c": []}, memory)
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
        said = {"text 1": "y"}
        assert sorted(tuple(r) for r in out.collect()) == sorted(
            (*r, said.get(r[1], r[1]), None, said.get(r[5], r[5])) for r in (rows if frame is df else [])
        )
    one = translate.apply_memory(df.withColumnRenamed("a_lang", "lang"), "id", "a", "lang", memory, [], "e")
    assert "SortAggregate" not in one._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["e"] for r in one.collect()} == {r[0]: said.get(r[1], r[1]) for r in rows}
