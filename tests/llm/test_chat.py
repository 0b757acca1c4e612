"""Chat windows against plain Python."""
import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, vocab
from tessera.llm.common import tune

SCHEMA = "conv_id bigint, turn bigint, role string, text string, window int, at string"
ODD = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nno", "<\\|im_end|>", "<\\\\/s> [\\INST] \\", "[[INST]<<s>", "<|endoftext|>", "a\\nb", "", None, "é\U0001f600<s>", "<" + "\\" * 70 + "s>"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    """conv_id -> turns in order, for rows without ties."""
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t, role or "", text or ""))
    return {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in out.items()}


def check(rows, windows, read):
    want = expected(rows)
    formatted = {}
    for w in windows:
        formatted[w.conv_id] = formatted.get(w.conv_id, 0) + len(w.text)
    assert {r.conv_id for r in read} == set(want) and len(read) == len(want)
    for r in read:
        turns = want[r.conv_id]
        said = "".join(x for role, x in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(said), digest(said), formatted[r.conv_id])


@pytest.mark.parametrize("budget", [64, 2048])
def test_reads_back_and_keeps_the_budget(spark, budget):
    rows = [(c, t, ["user", "assistant"][(t + c) % 2] if t or c % 3 else "system", ODD[(c + t) % len(ODD)] if t % 4 else f"word{t} " * (3 + t % 11)) for c in range(8) for t in range(12 + 30 * (c == 2))]
    rows += [(50, 0, "system", "s " * 300), (50, 1, "user", "u"), (50, 2, "assistant", "x" * 20000), (50, 3, "assistant", None), (51, 0, "od\\d\nrole<|im_end|>", "y"), (51, 1, None, "z"), (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    df = tune(spark).createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(5)
    made = chat.format_windows(df, budget=budget, history_tokens=16).cache()
    windows = made.collect()
    check(rows, windows, chat.read_back(made).collect())
    turns, path = expected(rows), vocab.default_path()
    for w in windows:
        own = turns[w.conv_id]
        system = own[0][0] == "system"
        parsed = [(chat.unescape_role(a), chat.unescape(b)) for a, b in chat.TURN.findall(w.text)]
        assert "".join(m.group(0) for m in chat.TURN.finditer(w.text)) == w.text and len(parsed) == w.n_new + w.n_repeated
        assert parsed[w.n_repeated:] == own[w.first_turn:w.first_turn + w.n_new]
        past = parsed[:w.n_repeated]
        if system and w.first_turn:
            assert past[0] == own[0]
            past = past[1:]
        assert len(past) <= chat.HISTORY and past == own[w.first_turn - len(past):w.first_turn]
        costs = [len(vocab.encode_ids(m.group(0), path)) for m in chat.TURN.finditer(w.text)]
        assert w.n_tokens == sum(costs) and sum(costs[w.n_repeated - len(past):w.n_repeated]) <= 16
        if system and costs[0] + 16 > budget * 3 // 4:
            continue
        assert w.n_tokens <= budget or w.n_new == 1
        masked = [w.text[s.begin:s.end] for s in w.loss]
        assert [chat.unescape(m) for m in masked] == [b for a, b in parsed[w.n_repeated:] if a == "assistant"]
    assert len(windows) > len(turns) if budget == 64 else len(windows) <= len(turns) + 10
    if budget == 64:
        assert any(w.n_repeated for w in windows)


def test_one_large_conversation_over_many_ranges(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} " + "word " * (t % 13)) for t in range(3000)] + [(2, 0, "user", "a")]
    df = tune(spark).createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(9)
    made = chat.format_windows(df, budget=128, history_tokens=32).cache()
    windows = sorted((w.window, w.first_turn, w.n_new, w.n_tokens) for w in made.collect() if w.conv_id == 1)
    check(rows, made.collect(), chat.read_back(made).collect())
    assert all(a[1] + a[2] == b[1] for a, b in zip(windows, windows[1:])) and max(w[3] for w in windows) <= 128 and len(windows) > 100


def test_ties_repeats_and_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.format_windows(empty).count() == 0 and chat.read_back(chat.format_windows(empty)).count() == 0
    rows = [(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, None, "user", "first")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    made = chat.format_windows(df)
    (w,) = made.collect()
    assert [b for _, b in chat.TURN.findall(w.text)] == ["first", "a", "b", "b"] and w.n_new == 4
    (r,) = chat.read_back(made).collect()
    assert (r.n_turns, r.loss_chars) == (4, 1)


def test_escaping_is_undone(spark):
    texts = [t for t in ODD if t is not None] + ["".join(t or "" for t in ODD) * 3]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.escape_role(F.col("t")).alias("r")).collect()
    for r in got:
        assert chat.unescape(r.e) == r.t and chat.unescape_role(r.r) == r.t
        assert not any(c in r.e for c in (chat.START, chat.END, "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")) and "\n" not in r.r


def test_query_on_the_given_table(spark):
    import __spark_entry__ as entry_points
    sf = "/root/testdata/sf0.001"
    got = {r.conv_id: r for r in entry_points.queries()["op12_chat"](spark, sf).collect()}
    said = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    want = expected(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        text = "".join(x for role, x in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)), len(text), digest(text))
