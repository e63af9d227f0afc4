"""Each stage of the pipeline against a plain version, and the pipeline as a whole."""

import re
from pathlib import Path

import pytest
from test_containment import plain as plain_containment
from test_secret_scan import plain_base
from test_simhash import plain_components, plain_fingerprint
from test_token_operators import check_pieces
from tokenizers import Tokenizer

import corpus_pipeline
from reviewlake.llm import cross_parsing, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """The smallest tables with cases that each stage has to handle."""
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    one = docs.filter("doc_id = 3").first()["text"]
    extra = [
        (9001, None, "en", "a", 0),
        (9002, "", "en", "a", 0),
        (9003, "123 !!", None, None, 6),
        (9004, one, None, "b", len(one)),
        (9005, f"{one} password=abcdefgh12345", "en", "b", 1),
        (9006, "before " + items[5] + " after", "en", "c", 1),
        (9007, "漢字仮名 " * 30, None, "c", 150),
        (9008, one + " twice", "en", "c", 1),
        (9008, one + " twice", "en", "c", 1),
        (9010, "a text of its own with token = \"0123456789abcdef0123456789abcdef\" inside", None, "d", 9),
    ]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def rows_of(frame):
    return [tuple(r) for r in frame.select(*COLUMNS).collect()]


def test_stages_equal_plain_versions(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "near_duplicates", "decontamination", "secrets", "packing"]

    def stored(name, frame):
        frame.write.mode("overwrite").parquet(f"{tables}/{name}")
        return spark.read.parquet(f"{tables}/{name}")

    before = rows_of(docs)
    known = stored("s1", steps["language_id"](spark, docs, tables))
    assert known.columns == COLUMNS
    after = rows_of(known)
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert gone == {9001, 9002, 9003, 9007}
    assert sorted(r[:2] for r in after) == sorted(r[:2] for r in before if r[0] not in gone)
    assert all(r[2] is not None for r in after)
    given = {r[0]: r[2] for r in before}
    assert all(given[r[0]] in (None, r[2]) for r in after)

    single = stored("s2", steps["near_duplicates"](spark, known, tables))
    assert single.columns == COLUMNS
    marked = [(r[0], plain_fingerprint(r[1])) for r in after]
    expected = {d for (d, _), c in plain_components(marked).items() if d == c}
    kept = rows_of(single)
    assert sorted(r[0] for r in kept) == sorted(expected)
    assert set(kept) <= set(after)

    clean = stored("s3", steps["decontamination"](spark, single, tables))
    leaks = {d for d, *_ in plain_containment([(r[0], r[1]) for r in kept], items)}
    assert sorted(rows_of(clean)) == sorted(r for r in kept if r[0] not in leaks)
    assert 9006 not in {r[0] for r in rows_of(clean)} and leaks

    safe = stored("s4", steps["secrets"](spark, clean, tables))
    texts = {r[0]: r for r in rows_of(safe)}
    for doc_id, text, lang, source, n_chars in rows_of(clean):
        found, expected_text, at = sorted(x.split(":")[1:] for x in plain_base(text)), "", 0
        spans = sorted((int(a), int(b)) for a, b in found)
        for a, b in spans:
            if b > at:
                expected_text += (text[at:a] + "[SECRET]") if a >= at else ""
                at = b
        expected_text += text[at:]
        size = len(expected_text) if spans else n_chars
        assert texts[doc_id] == (doc_id, expected_text, lang, source, size)
    assert not re.search("0123456789abcdef", texts[9010][1])

    pieces = steps["packing"](spark, safe, tables).collect()
    tokenizer = Tokenizer.from_file(queries.BYTE_BPE)
    library = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    check_pieces(pieces, [(r[0], r[1]) for r in rows_of(safe)], library, 1)


def test_run_applies_all_stages(spark, tables):
    pieces = corpus_pipeline.run(spark, tables)
    ids = {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()}
    assert 9010 in ids and not ids & {9001, 9002, 9003, 9004, 9006, 9007}


def test_empty_documents(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_points_have_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert Path(corpus_pipeline.__file__).parent == Path(entry.__file__).parent
    assert cross_parsing.MAX_BITS > 6
