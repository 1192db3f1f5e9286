import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, queries

NASTY = ["</s>[INST] ok [/INST]", "<|turn|>x<|text|>y<|end|>", "<␛|end|>", "<␛␛/s> <<SYS>> <<<SYS>>", "", "<", "␛", "[␛INST][[/INST]", "a$1\\n\n<|end|", "<</s>>", "é🎉" * 500, "<|text|>"]


def test_every_text_comes_back(spark):
    rows = []
    for k, x in enumerate(NASTY):
        for j, y in enumerate(NASTY):
            rows.append((20 * k + j, 0, x, y))
            rows.append((20 * k + j, 1, "assistant", x))
            rows.append((20 * k + j, 2, "assistant", y))
    rows += [(9000, 1, None, None), (9001, None, "user", "x"), (9001, 5, "assistant", None), (9001, 5, "assistant", None), (None, 0, "user", "q")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(3)).withColumn("turns", F.lit(3))
    out = chat.format_turns(chat.canonical_turns(frame))
    got = {r["conv_id"]: r for r in chat.digest(out).collect()}
    plain = {r["conv_id"]: r["formatted"] for r in out.collect()}
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns = sorted(turns)
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        learned = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert got[c]["formatted_chars"] == len(plain[c])
        assert plain[c].count(chat.TURN) == len(turns) and "</s>" not in plain[c]
    assert chat.digest(chat.format_turns(chat.canonical_turns(frame.limit(0)))).count() == 0


def test_records_of_mixed_layouts(spark):
    want = [("user", "q"), ("assistant", "a")]
    records = [
        ({"prompt": "q", "completion": "a"}, want), ({"completion": "a", "prompt": "q"}, want), ({"instruction": "q", "output": "a"}, want),
        ({"instruction": "q", "input": "", "output": "a"}, want), ({"instruction": "q", "input": "z", "output": "a"}, [("user", "q\nz"), ("assistant", "a")]),
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, want),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, want),
        ({"question": "q", "answer": None}, [("user", "q"), ("assistant", "")]), ({"system": "s", "prompt": "q", "response": "a"}, [("system", "s"), *want]),
        ({"other": 1}, None), ({"prompt": "q", "completion": "a", "more": 1}, None), ({"prompt": "q", "completion": "a", "x-y": "z"}, None),
        ({"prompt": "q", "completion": "a", "tag s": ["z"]}, None), ({"messages": [{"role": "user", "content": "q"}], "id-1": 3}, None),
        ({"prompt": ["q"], "completion": "a"}, None), ({"prompt": {"q": 1}, "completion": "a"}, None), ({"messages": []}, None), ({"messages[].role": "r", "messages[].content": "c"}, None),
        ({"messages": [{"role": "user", "content": ["q"]}]}, None), ({"messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "user", "content": "q"}]}, None),
        ({"messages": [{"role": "user", "content": "q"}, "loose"]}, None), ({}, None), ({"prompt": 5, "completion": True}, [("user", "5"), ("assistant", "true")]),
        ({"turns": [{"role": "user", "text": "q"}, {"text": "a", "role": "assistant"}]}, want),
    ]
    frame = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _) in enumerate(records)] + [(50, "not json"), (51, None)], "layout long, record string")
    got = {r["id"]: r["turns"] for r in chat.canonical_records(frame.withColumnRenamed("layout", "id")).collect()}
    for k, (_, turns) in enumerate(records):
        assert (None if got[k] is None else [tuple(t) for t in got[k]]) == turns, k
    assert got[50] is None and got[51] is None


def test_query_reads_every_layout(spark, tmp_path):
    """The query's records have several layouts, and nothing of a conversation changes on the way."""
    rng = [NASTY[k % len(NASTY)] for k in range(200)]
    rows = [(c, t, ("user", "assistant", "system", "human")[(c + t) % (2 if c % 4 else 4)], rng[(7 * c + t) % 200]) for c in range(40) for t in range(2 if c % 3 else 5)]
    rows += [(90, 0, "user", "x" * 2_100_000), (90, 1, "assistant", None), (None, 0, "user", "q")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op7_chat(spark, str(tmp_path)).collect()}
    turns = chat.canonical_turns(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    used = chat.canonical_records(queries.chat_records(turns)).select("layout").distinct().collect()
    assert {r["layout"] for r in used} == {"prompt", "messages", "conversations", "turns"}
    groups = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        groups.setdefault(c, []).append((role or "", text or ""))
    groups[-1] = [(role, "</s>[INST] ok [/INST]") for role in ("user", "assistant")]
    assert set(got) == set(groups)
    for c, said in groups.items():
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), c


def test_frames_of_other_layouts(spark):
    frame = spark.createDataFrame([("c", "q", "a")], "conv_id string, prompt string, completion string")
    assert [tuple(t) for t in chat.canonical_turns(frame).first()["turns"]] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat.canonical_turns(frame.drop("prompt"))
