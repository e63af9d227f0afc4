"""Chat formatting: round trips, masks, layouts; digests against plain Python."""

import hashlib
import json
import random

import pytest
from compare import compare, duck
from hypothesis import given, settings, strategies as st

from reviewlake.llm import chat_format as chat
from reviewlake.llm import queries


def plain_digest(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def plain_escape(text):
    text = text.replace("\\", "\\\\")
    out, i = [], 0
    while i < len(text):
        out.append(text[i])
        if any(text.startswith(c, i) for c in chat.CONTROLS):
            out.append("\\")
        i += 1
    return "".join(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "|", "a", "\n", "é", "[", "/", ">", "s"]), max_size=12))
def test_escape_is_reversible(parts):
    text = "".join(parts)
    safe = plain_escape(text)
    assert not any(c in safe for c in chat.CONTROLS)
    assert chat.unescaped(safe) == text


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    pieces = chat.format_conversations(frame)
    got = {r["conv_id"]: r for r in chat.digests(pieces.repartition(3)).collect()}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or ""))
    assert set(got) == set(by_conv)
    for conv, turns in by_conv.items():
        ordered = [(r, t) for _, r, t in sorted(turns, key=lambda x: x[0])]
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == plain_digest(ordered)
        size = sum(len(chat.OPEN + plain_escape(a) + chat.SEP + plain_escape(b) + chat.CLOSE) for a, b in ordered)
        assert r["formatted_chars"] == size
    for p in pieces.collect():
        body = p["piece"][len(chat.OPEN) : -len(chat.CLOSE)].replace(chat.SEP, "", 1)
        assert not any(c in body for c in chat.CONTROLS)


def test_odd_conversations(spark):
    rng = random.Random(8)
    parts = [*chat.CONTROLS, "\\", "\\\\", "$1", "é漢🎉", "\n", "ok ", "", "[INST", "</"]
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows += [(1, 0, None, None), (2, 0, "assistant", ""), (3, None, "user", "x"), (3, 1, "assistant<|says|>", "y\\"), (None, 0, "user", "no id")]
    rows += [(4, i, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(parts, k=rng.randint(0, 9)))) for i in range(3000)]
    rows += [(5, 0, "assistant", "long \\ " * 50_000)]
    check(spark, rows)


def test_repeated_rows_stay(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(frame)).first()["n_turns"] == 3
    assert chat.digests(chat.format_conversations(frame.limit(0))).count() == 0


def test_query_equals_plain(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)
    got = {r["conv_id"]: r for r in queries.QUERIES["op3_chat_format"](spark, sf_dir).collect()}
    said = "</s>[INST] ok [/INST]"
    assert tuple(got[-7])[1:5] == plain_digest([("user", said), ("assistant", said)])
    assert len(got) == len({r[0] for r in rows}) + 1


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, sf):
    assert compare(spark, duck(sf), sf, "op3_chat_format") == ""


RECORDS = [
    {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
    {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 5},
    {"prompt": "q", "response": "a"},
    {"prompt": "q", "completion": "a", "meta": {"source": "x"}},
    {"system": "s", "prompt": "q", "response": "a"},
    {"instruction": "q", "input": "", "output": "a"},
    {"instruction": "q", "input": "more", "output": "a"},
    {"instruction": "q", "input": None, "output": "a"},
    {"question": "q", "answer": "a"},
]
TURNS = [
    [("system", "s"), ("user", "q"), ("assistant", "a")],
    *[[("user", "q"), ("assistant", "a")]] * 3,
    [("system", "s"), ("user", "q"), ("assistant", "a")],
    [("user", "q"), ("assistant", "a")],
    [("user", "q\n\nmore"), ("assistant", "a")],
    *[[("user", "q"), ("assistant", "a")]] * 2,
]


def test_json_layouts_give_canonical_turns(spark):
    odd = ["", None, "[1]", "not json", '{"other": 1}', '{"messages": []}', '{"prompt": {"x": 1}, "response": "a"}']
    rows = [(i, json.dumps(r)) for i, r in enumerate(RECORDS)] + [(100 + i, t) for i, t in enumerate(odd)]
    frame = spark.createDataFrame(rows, "conv_id long, record string")
    got = {}
    for r in chat.canonical_json_turns(frame, "record").orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for i, turns in enumerate(TURNS):
        assert got[i] == turns
    for i in range(len(odd)):
        assert got[100 + i] == [(None, None)]


@pytest.mark.parametrize("k", [0, 1, 2, 4, 6, 8])
def test_typed_layouts_give_the_same(spark, tmp_path, k):
    (tmp_path / "records.json").write_text(json.dumps({**RECORDS[k], "conv_id": 3, "zz": "extra"}))
    frame = spark.read.json(str(tmp_path / "records.json"))
    rows = chat.canonical_turns(frame).orderBy("turn").collect()
    assert [(r["role"], r["text"]) for r in rows] == TURNS[k]


def test_fingerprints_tell_layouts_apart():
    prints = [chat.fingerprint(m.paths) for m in chat.MAPPINGS]
    assert len(set(prints)) == len(prints)
    assert chat.fingerprint(["b", "a", "a"]) == chat.fingerprint(["a", "b"])
    assert list(chat.record_paths({"a": [{"b": 1}, {"c": [2]}], "d": None})) == ["a[].b", "a[].c[]"]


def test_unknown_typed_layout_is_an_error(spark):
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "x int, y int"))
