import hashlib
import json

import pytest

from tallyframe.llm.chat_format import KNOWN, canonical, canonical_records, digests, fingerprint, loss_text, mapping_of, read_back, render
from pyspark.sql import functions as F

TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "\\l \\e \\b \\\\", "<s>[user]x</s>", "a]b[c<d\\", "\n" + chr(0x1F600) + "<"]


def test_round_trip_and_loss(spark):
    rows = [(c, k, ["user", "assistant", "sys]<[\\tem"][k % 3], TEXTS[(c + k) % len(TEXTS)], "x") for c in range(7) for k in range(9)]
    rows += [(100, 1, None, None, "x"), (None, 0, "user", "no id", "x"), (100, 0, "assistant", "a" * 100000, "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string").repartition(3)
    out = render(canonical(table))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    told = {r.conv_id: r for r in digests(out).collect()}
    for conv in {r[0] for r in rows}:
        want = [(role or "", text or "") for _, _, role, text, _ in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        learned = "".join(t for r, t in want if r == "assistant")
        assert got[conv].learned == learned
        d = told[conv]
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(want), len(learned), len(got[conv].formatted))
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert render(canonical(table.limit(0))).count() == 0


def test_layouts_of_records(spark):
    records = [
        {"prompt": "p", "response": "r", "id": 3},
        {"prompt": "p", "completion": "c"},
        {"instruction": "i", "input": "", "output": "o"},
        {"instruction": "i", "input": "x", "output": "o", "source": {"a": [1]}},
        {"system": "s", "instruction": "i", "output": "o"},
        {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": None}]},
        {"question": "unknown layout"},
    ]
    rows = [(k, json.dumps(r)) for k, r in enumerate(records)] + [(98, "not json"), (99, None)]
    found = {r.conv_id: r.turns and [(t.role, t.text) for t in r.turns] for r in canonical_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert found == {
        0: [("user", "p"), ("assistant", "r")],
        1: [("user", "p"), ("assistant", "c")],
        2: [("user", "i"), ("assistant", "o")],
        3: [("user", "i\n\nx"), ("assistant", "o")],
        4: [("system", "s"), ("user", "i"), ("assistant", "o")],
        5: [("user", "u"), ("assistant", "a")],
        6: [("user", "u"), ("assistant", "")],
        7: None, 98: None, 99: None,
    }


def test_records_with_more_than_a_mapping_names(spark):
    records = [
        {"messages": [{"role": "user"}, {"role": "assistant", "content": "a"}], "system": "s", "prompt": "other"},
        {"messages": [{"content": "no role"}, {"role": "user", "content": "u"}], "output": "other", "instruction": "x"},
        {"conversations": [{"from": "system"}, {"from": "human", "value": "u", "messages": 3}], "response": "r"},
        {"prompt": "p", "response": "r", "completion": "c", "input": "i", "role": "user", "text": "t", "turn": 1, "conv_id": 5},
        {"instruction": "i", "output": "o", "prompt": "p", "messages": []},
        {"messages": [{"role": "user"}, {"role": "assistant"}]},
    ]
    rows = [(k, json.dumps(r)) for k, r in enumerate(records)]
    found = {r.conv_id: r.turns and [(t.role, t.text) for t in r.turns] for r in canonical_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert found == {
        0: [("system", "s"), ("user", ""), ("assistant", "a")],
        1: [("", "no role"), ("user", "u")],
        2: [("system", ""), ("user", "u")],
        3: [("user", "p"), ("assistant", "r")],
        4: [("user", "i"), ("assistant", "o")],
        5: None,
    }


def test_table_layout_is_chosen_by_its_paths(spark):
    with pytest.raises(ValueError):
        canonical(spark.createDataFrame([(1, "x")], "conv_id long, words string"))
    with pytest.raises(ValueError):
        canonical(spark.createDataFrame([("x", "y")], "prompt string, response string"))  # one row a record, not a turn
    others = [c for c in (*KNOWN, "other") if "[" not in c]
    table = spark.createDataFrame([(1, k, "user", str(k), *[None] * len(others), [("assistant", "x")]) for k in range(3)], "conv_id long, turn int, role string, text string, " + ", ".join(f"{c} string" for c in others) + ", messages array<struct<role:string,content:string>>")
    assert [[t.text for t in r.turns] for r in canonical(table).collect()] == [["0", "1", "2"]]
    assert mapping_of(["turn", "text", "role", "conv_id", "other"]).rows
    assert mapping_of(["prompt", "response", "input"]).paths == ("prompt", "response")
    assert fingerprint(["b", "a", "c"], ["a", "b"]) == fingerprint(["a", "b"], ["a", "b", "d"])
