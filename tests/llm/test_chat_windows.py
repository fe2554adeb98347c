from __future__ import annotations

import random
import re

import pytest
from llm_fixtures import sentence, with_clashes

import tallyloom.llm.chat_windows as cw
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def esc(x):
    return re.sub(r"([<\[])(\\*)(/?(?:s>|INST\]))", r"\1\\\2\3", x)


def conversation(conv, n, seed, system=False, size=60):
    draw = random.Random(seed)
    roles = (["system"] if system else []) + [("user", "assistant")[i % 2] for i in range(n)]
    return [(conv, k, role, sentence(seed * 1000 + k, draw.randint(1, size))) for k, role in enumerate(roles)]


HARD = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s> [\\INST]", "<", "[", "</", "s>", "\\", "", "<s><s>", "[INST][/INST]", "é😀</s>", "\n\n"]
ROWS = [
    *conversation(1, 1, 1),
    *conversation(2, 9, 2, system=True),
    *conversation(3, 40, 3, system=True, size=300),
    *conversation(4, 60, 4, size=20),
    *[(5, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(HARD)],
    *[(6, k, t, "x") for k, t in enumerate(HARD)],
    (7, 0, "system", "alone"),
    (8, 0, "system", "twice"),
    (8, 0, "system", "twice"),
    (8, None, "assistant", None),
    (8, 5, None, "no role"),
    (9, 0, "assistant", sentence(9, 5000)),
    (9, 1, "user", "after a turn that exceeds any budget"),
    (9, -3, "system", sentence(10, 2500)),
    (None, 0, "user", "no"),
    (None, 1, "assistant", "conversation"),
    (11, 0, "user", "x"),
    (11, 5000, "assistant", "far block"),
    (11, 2000, "assistant", "middle block"),
]


@pytest.fixture(scope="module")
def turns(spark):
    return with_clashes(spark.createDataFrame(ROWS, SCHEMA)).repartition(3)


def ordered(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((1 << 63 if turn is None else turn, role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(x)] for c, x in out.items()}


@pytest.mark.parametrize("budget,history", [(2048, 512), (200, 50), (40, 0), (1, 0), (60, 1000)])
def test_round_trip(turns, budget, history):
    back = {r.conv: r for r in cw.read_back(cw.chat_windows(turns, budget, history)).collect()}
    want = ordered(ROWS)
    assert set(back) == set(want)
    for conv, spoken in want.items():
        assert [(t.role, t.text) for t in back[conv].turns] == spoken, conv
        assert "".join(back[conv].losses) == "".join(t for r, t in spoken if r == "assistant"), conv


def test_windows_keep_the_budget_and_lead_with_the_system_turn(turns):
    for budget, history in [(400, 100), (2048, 512)]:
        windows = cw.chat_windows(turns, budget, history).collect()
        want = ordered(ROWS)
        for w in windows:
            roles = re.findall(r"\[INST\] (new|old) (.*?) \[/INST\]", w.text)
            first = want[w.conv][0]
            if first[0] == "system":
                assert roles[0][1] == "system" and esc(first[1]) in w.text
            led = len(first[1].encode()) // 4 + 1 if first[0] == "system" else 0
            largest = max((len(t.encode()) + 3) // 4 for _, t in want[w.conv])
            assert w.n_tokens <= budget or 2 * largest > budget - history - led, (w.conv, w.n_tokens)
            for s in w.loss:
                assert 0 < s.start <= s.end < len(w.text)
        starts = [w for w in windows if w.conv == 3]
        assert len(starts) > 1 and any(" old " in w.text and "old user" in w.text for w in starts)


def test_history_is_what_comes_right_before(turns):
    windows = sorted((w for w in cw.chat_windows(turns, 200, 50).collect() if w.conv == 4), key=lambda w: w.window_start)
    texts = [t for _, t in ordered(ROWS)[4]]
    at = 0
    for w in windows:
        pieces = re.findall(r"\[INST\] (new|old) .*? \[/INST\](.*?)</s>", w.text, re.S)
        old, new = [t for k, t in pieces if k == "old"], [t for k, t in pieces if k == "new"]
        assert new == texts[at : at + len(new)] and old == texts[at - len(old) : at]
        assert sum(max(1, (len(t.encode()) + 3) // 4) for t in old) <= 50
        at += len(new)
    assert at == len(texts)


def test_token_column_and_empty_table(turns):
    counted = turns.withColumn("count", F.lit(30))
    windows = cw.chat_windows(counted, 200, 0, tokens_col="count").where("conv = 4").collect()
    assert {w.n_turns for w in windows} <= {3, 4} and sum(w.n_turns for w in windows) == 60
    assert cw.read_back(cw.chat_windows(turns.limit(0))).count() == 0


@pytest.mark.parametrize("node", ["Python", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"])
def test_plan_is_native(turns, node):
    assert node not in cw.read_back(cw.chat_windows(turns))._jdf.queryExecution().executedPlan().toString()
