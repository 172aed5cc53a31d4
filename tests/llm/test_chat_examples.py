"""Chat examples: round trips, masks, edge cases."""

import hashlib
import random

from pyspark.sql import functions as F

from hyperlake.llm import chat_examples, queries

KIND = "conv_id long, turn long, role string, text string"
SIGNS = ["<", "\\", "s>", "/s>", "[", "INST]", "/INST]", "<SYS>>", "</SYS>>", "|im_end|>", "|im_start|>", "|im_sep|>", "</s>", "[INST]", "a", " ", "\n", "é", "$1", "€😀"]


def texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choices(SIGNS, k=r.randrange(12))) for _ in range(n)]


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    df = spark.createDataFrame([(t,) for t in texts(4000)], "t string").withColumn("e", chat_examples.escape(F.col("t")))
    rows = df.withColumn("u", chat_examples.unescape(F.col("e"))).collect()
    for r in rows:
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<|im_end|>", "<|im_start|>", "<|im_sep|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
        assert len(r["e"]) >= len(r["t"])


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text in rows if k == c))
        loss = "".join(x for *_, role, x in turns if role == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_examples_read_back_whole_conversations(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "assistant", None, "<|im_sep|>\n"]), x or None) for (c, t), x in zip([(c, t) for c in range(40) for t in range(r.randrange(1, 9))], texts(400, 9))]
    # nulls, ties, repeated rows, no reply at all, only replies, one long conversation and one long text
    rows += [(100, None, "user", "first"), (100, 0, "user", "b"), (100, 0, "user", "a"), (100, 0, "user", "a"), (101, 0, "user", None), (102, 0, "assistant", ""), (102, 1, "assistant", "x"), (None, 0, "assistant", "nobody")]
    rows += [(103, t, "assistant" if t % 2 else "user", f"turn {t} </s>") for t in range(300)] + [(104, 0, "assistant", "long <s> é " * 50_000)]
    df = spark.createDataFrame(rows, KIND)
    for n in ("n", "end", "piece", "whole", "size", "turns", "example", "closing"):
        df = df.selectExpr("*", f"'x' as `{n}`")
    got = chat_examples.digests(chat_examples.examples(df)).collect()
    assert {g["conv_id"]: (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) for g in got} == brute(rows)


def test_each_reply_is_an_example_with_all_turns_before_it(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a[INST]"), (1, 3, "user", "r"), (1, 4, "assistant", "b"), (1, 5, "user", "bye")]
    got = chat_examples.examples(spark.createDataFrame(rows, KIND)).orderBy("example").collect()
    start = "<|im_start|>system<|im_sep|>s<|im_end|><|im_start|>user<|im_sep|>q<|im_end|>"
    first = start + "<|im_start|>assistant<|im_sep|>a[\\INST]<|im_end|>"
    second = first + "<|im_start|>user<|im_sep|>r<|im_end|><|im_start|>assistant<|im_sep|>b<|im_end|>"
    third = second + "<|im_start|>user<|im_sep|>bye<|im_end|>"
    assert [(g["example"], g["n_turns"], g["text"], g["closing"]) for g in got] == [(1, 3, first, False), (2, 5, second, False), (3, 6, third, True)]
    assert [g["text"][g["loss_start"] : g["loss_end"]] for g in got] == ["a[\\INST]", "b", ""]


def test_empty_table(spark):
    assert chat_examples.examples(spark.createDataFrame([], KIND)).count() == 0
    assert chat_examples.digests(chat_examples.examples(spark.createDataFrame([], KIND))).count() == 0


def test_query_runs_no_python_in_its_plan(spark):
    plan = queries.op11_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
