"""Cross-parsing against a plain search for longest matches, and held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import cross_parsing as cp
from reviewlake.llm import queries


def plain_phrases(signs, sample):
    """Greedy longest matches; a phrase ends with its segment."""
    count = 0
    for at in range(0, len(signs), cp.SEGMENT):
        rest = signs[at : at + cp.SEGMENT]
        while rest:
            n = 1
            while n < len(rest) and rest[: n + 1] in sample:
                n += 1
            if rest[0] not in sample:
                n = 1
            rest = rest[n:]
            count += 1
    return count


def test_phrases_equal_plain_search():
    rng = random.Random(3)
    sample = "".join(rng.choice("ab cd") for _ in range(900))
    profiles = (cp.Profile("x", sample), cp.Profile("y", sample[300:] + "xyz"))
    texts = ["".join(rng.choice("abcdxyzü ,.A") for _ in range(n)) for n in (1, 2, 50, 511, 512, 513, 5000)]
    texts += ["", "...", "Ü", "ab" * 400]
    costs = cp.costs(texts, profiles)
    for row, text in zip(costs, texts):
        signs = cp.fold(text)
        if not signs.strip():
            assert np.isnan(row).all()
            continue
        for value, profile in zip(row, profiles):
            expected = plain_phrases(signs, profile.sample) * np.log2(len(profile.sample)) / len(signs)
            assert abs(value - expected) < 1e-9, (text[:30], profile.language)


def test_folding_keeps_letters_and_single_spaces():
    assert cp.fold("Ab--C 12 Ü.") == " ab c ü "
    assert cp.fold("") == " " and cp.fold("!!") == " "


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op5_language_id"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(both) == len(labels) and 0.1 < both.held_out.mean() < 0.3
    assert (held.lang_pred == held.lang).mean() > 0.99
    assert both.score.between(0, 1).all()


def test_odd_rows(spark):
    rows = [(i, "the cat sat on the mat and the dog", "en") for i in range(10)]
    rows += [(100 + i, "die katze sitzt auf der matte und der hund", "de") for i in range(10)]
    rows += [(300, None, "en"), (301, "ignored", None), (None, "the", "en"), (302, "...", "fr")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = cp.fit_profiles(labelled)
    assert [p.language for p in profiles] == ["de", "en"]
    texts = [None, "", "12 34", "THE CAT!!", "die KATZE", "the cat " * 20_000, "漢字"]
    docs = spark.createDataFrame(
        [(i, t, "zz", "clash") for i, t in enumerate(texts)] + [(3, texts[3], None, "x"), (None, texts[4], None, "x")],
        "doc_id long, text string, lang string, score string",
    )
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in cp.predict(docs, profiles).collect()}
    for key in [(0, "und"), (1, "und"), (2, "und"), (3, "en"), (4, "de"), (5, "en"), (None, "de")]:
        assert key in got, (key, got)
    assert got[(0, "und")] == 0
    assert cp.predict(docs, profiles).count() == len(texts) + 2
    kept = cp.keep_known_language(docs, profiles, max_bits=7)
    assert kept.columns == docs.columns
    found = sorted((r["doc_id"], r["lang"], r["score"]) for r in kept.filter("doc_id IS NOT NULL").collect())
    assert [r[:2] for r in found if r[1] == "zz"] == [(3, "zz"), (4, "zz"), (5, "zz")]
    assert [r["lang"] for r in kept.filter("doc_id IS NULL OR lang != 'zz'").orderBy("lang").collect()] == ["de", "en"]


def test_no_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert cp.fit_profiles(empty) == ()
    assert cp.keep_known_language(empty, ()).count() == 0
    docs = spark.createDataFrame([(1, "text", "en")], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in cp.predict(docs, ()).collect()] == ["und"]
    assert cp.predict(empty, ()).count() == 0
    assert cp.keep_known_language(docs, ()).collect() == docs.collect()


def test_hashed_moves_equal_dense_ones(monkeypatch):
    rng = random.Random(4)
    sample = "".join(chr(0x4E00 + rng.randint(0, 800)) for _ in range(4000))
    texts = [sample[i : i + rng.randint(1, 40)] + chr(0x5E00) for i in range(0, 4000, 97)]
    profiles = (cp.Profile("zh", sample),)
    dense = cp.costs(texts, profiles)
    cp.parsers.cache_clear()
    monkeypatch.setattr(cp, "DENSE_CELLS", 0)
    hashed = cp.costs(texts, profiles)
    assert not cp.parsers(profiles)[0].dense and cp.parsers(profiles)[0].table.nbytes < 1 << 20
    cp.parsers.cache_clear()
    assert (dense == hashed).all()


def test_sample_comes_from_all_over_the_texts(spark):
    head = "header " * 600
    rows = [(i, head + "schöne wörter stehen weiter hinten " * 300, "de") for i in range(30)]
    profile = cp.fit_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"))[0]
    assert profile.sample.count("wörter") > 300


def test_too_many_languages_are_an_error(spark):
    rows = [(i, "text", f"l{i}") for i in range(cp.MAX_LANGUAGES + 1)]
    with pytest.raises(ValueError, match="values of lang"):
        cp.fit_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


FOREIGN = {
    "nl": "De raad van bestuur heeft gisteren besloten dat het nieuwe gebouw volgend jaar wordt geopend, zodra de werkzaamheden klaar zijn.",
    "fi": "Kaupunginhallitus päätti eilen, että uusi rakennus avataan ensi vuonna, kunhan työt ovat valmiit ja rahoitus järjestyy.",
    "pl": "Zarząd miasta postanowił wczoraj, że nowy budynek zostanie otwarty w przyszłym roku, gdy tylko prace zostaną ukończone.",
    "tr": "Belediye meclisi dün yeni binanın çalışmalar biter bitmez önümüzdeki yıl açılmasına karar verdi ve bütçeyi onayladı.",
}


def test_foreign_texts_of_the_same_script_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = cp.fit_profiles(docs.filter(~queries.learning_part(5, 0)))
    assert all(2 < p.max_bits < cp.MAX_BITS for p in profiles), [p.max_bits for p in profiles]
    planted = [(10_000 + i, f"{t} {t}", None, "x", 1) for i, t in enumerate(FOREIGN.values())]
    both = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    kept = {r["doc_id"] for r in cp.keep_known_language(both, profiles).select("doc_id").collect()}
    assert not kept & {p[0] for p in planted}
    lettered = {r["doc_id"] for r in docs.filter(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert len(lettered - kept) <= 0.002 * len(lettered), lettered - kept
