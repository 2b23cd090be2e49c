"""Prefix-target expansion: round trips, masks, places, odd rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from attest.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """What must come back: (turns, replies, chars) per conversation."""
    told = defaultdict(list)
    for conv, turn, role, text in rows:
        told[conv].append(((turn is None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in told.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        at, covered, reach = 0, 0, 0
        for _, role, text in turns:
            shown = [s.replace("\\", "\\\\").replace("<|", "<\\|") for s in (role, text)]
            at += len(f"<|turn|>{shown[0]}<|text|>{shown[1]}<|end|>")
            if role == "assistant":
                covered, reach = covered + at, at
        out[conv] = ([(r, t) for _, r, t in turns], [t for _, r, t in turns if r == "assistant"], covered + at - reach)
    return out


def odd_rows():
    r = random.Random(4)
    bits = ["\\", "<|", "|", "<", "<|end|>", "<|turn|>", "<\\|", "é🙂", "\n", "", "\\### Assistant: </turn> ok", "word "]
    rows = [(c, t, r.choice(["user", "assistant", "system", "assistant<|text|>", "\\"]), "".join(r.choices(bits, k=r.randint(0, 9))))
            for c in range(40) for t in range(r.randint(1, 12))]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (50, None, "assistant", None), (50, None, None, "x"), (50, 3, "user", "\\"),
             (51, 1, "assistant", "same"), (51, 1, "assistant", "same"), (51, 1, "user", "same"), (52, 0, "user", None),
             (53, -5000, "assistant", "early"), (53, 5000, "assistant", "late"), (54, 0, "assistant", "long <|" * 100_000)]
    rows += [(60, t, "assistant" if t % 2 else "user", f"turn {t} \\") for t in range(3000)]
    return rows


def test_everything_comes_back(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"piece": F.lit(1), "block": F.lit("b"), "start": F.lit(2)}).repartition(7)
    got = {x.conv_id: ([tuple(t) for t in x.turns], x.losses, x.chars)
           for x in chat.conversations_back(chat.formatted_turns(df)).collect()}
    assert got == plain(rows)


def test_examples_are_prefixes_with_one_trainable_reply(spark):
    rows = [x for x in odd_rows() if x[0] not in (54, 60)]
    placed = chat.formatted_turns(spark.createDataFrame(rows, SCHEMA))
    whole = {c: "".join(p for _, p in sorted(pieces)) for c, pieces in
             placed.groupBy("conv_id").agg(F.collect_list(F.struct("start", "piece"))).collect()}
    want = plain(rows)
    seen = defaultdict(list)
    for x in chat.example_texts(placed).collect():
        assert x.text == whole[x.conv_id][:x.chars] and x.text.endswith("<|end|>") and x.text.count("<|end|>") == x.n_turns
        masked = x.text[x.loss_start:x.loss_start + x.loss_size]
        assert x.text == x.text[:x.loss_start] + masked + "<|end|>"
        seen[x.conv_id].append((x.example, masked.replace("<\\|", "<|").replace("\\\\", "\\") if "\\\\|" not in masked else None, x.n_turns))
    for conv, (turns, replies, _) in want.items():
        got = sorted(seen.get(conv, []), key=lambda e: e[0])
        assert [e[0] for e in got] == list(range(len(replies)))
        assert [e[2] for e in got] == [i + 1 for i, t in enumerate(turns) if t[0] == "assistant"]
        assert all(text is None or text == reply for (_, text, _), reply in zip(got, replies))


def test_long_conversation_is_spread_over_blocks(spark):
    rows = [(1, t, "assistant", "x" * (t % 7)) for t in range(5000)]
    placed = chat.formatted_turns(spark.createDataFrame(rows, SCHEMA))
    assert placed.select("block").distinct().count() == 5
    at = 0
    for i, x in enumerate(placed.orderBy("start").collect()):
        assert (x.start, x.turns_before, x.replies_before, x.turn) == (at, i, i, i)
        at += x.size


def test_empty_table_and_types(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.conversations_back(chat.formatted_turns(df)).count() == 0
    assert chat.examples(chat.formatted_turns(df)).count() == 0
    named = spark.createDataFrame([("c", 1, "assistant", "hi")], "c string, n int, who string, said string")
    row = chat.examples(chat.formatted_turns(named, "c", "n", "who", "said")).first()
    assert (row.conv_id, row.example, row.n_turns, row.loss_size, row.reply) == ("c", 0, 1, 2, "<|turn|>assistant<|text|>hi<|end|>")


def test_main_path_has_no_python(spark):
    plan = chat.conversations_back(chat.formatted_turns(spark.createDataFrame(odd_rows(), SCHEMA).where("turn > 0")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text and "CartesianProduct" not in text


def test_examples_hold_their_whole_texts(spark):
    rows = [(1, 0, "system", "be\\ kind"), (1, 1, "assistant", "a <|end|>"), (1, 2, "user", "é🙂"), (1, 3, "assistant", ""), (1, 4, "user", "bye")]
    shown = ["<|turn|>system<|text|>be\\\\ kind<|end|>", "<|turn|>assistant<|text|>a <\\|end|><|end|>", "<|turn|>user<|text|>é🙂<|end|>",
             "<|turn|>assistant<|text|><|end|>"]
    got = chat.examples(chat.formatted_turns(spark.createDataFrame(rows, SCHEMA))).orderBy("example").collect()
    assert [x.text for x in got] == ["".join(shown[:2]), "".join(shown)]
    assert [x.text[x.loss_start:x.loss_start + x.loss_size] for x in got] == ["a <\\|end|>", ""]


def test_what_comes_back_is_read_from_example_texts(spark, monkeypatch):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "yes"), (1, 2, "assistant", "no"), (1, 3, "user", "z"), (2, 0, "user", "alone")]
    cut = chat.whole_conversations
    monkeypatch.setattr(chat, "whole_conversations", lambda placed: cut(placed).withColumn("formatted", F.replace("formatted", F.lit("yes"), F.lit("YES"))))
    got = {x.conv_id: x for x in chat.conversations_back(chat.formatted_turns(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[1].losses == ["YES", "no"] and [t.text for t in got[1].turns] == ["q", "YES", "no", "z"]
    assert got[2].losses == [] and [tuple(t) for t in got[2].turns] == [("user", "alone")]
