import hashlib
import random

import pytest

from spanalign.llm import chat

BITS = ["</s>", "<\\/s>", "[INST]", "[\\\\INST]", "<|end|>", "<\\|end|>", "<|turn|>", "<|says|>", "\\", "<", "[", "a b", "\n", "é😀", "<<SYS>>", "<\\<SYS>>", "word " * 40, ""]


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(2)
    rows = []
    for c in [*range(40), None]:
        for k in range(rng.choice([1, 3, 30, 700 if c == 5 else 4])):
            role = "system" if k == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "tool<|end|>", None])
            text = None if rng.random() < 0.05 else "".join(rng.choice(BITS) for _ in range(rng.randint(0, 6))) + " w" * rng.choice([0, 5, 100, rng.choice([0, 900])])
            rows.append((c, None if c == 3 and k == 2 else k, role, text))
    rows += [rows[0], rows[0], (0, 1, "assistant", "tie"), (0, 1, "assistant", "tie")]
    rows.append((-7, 0, "user", "</s>[INST] ok [/INST]"))
    rows.append((-7, 1, "assistant", "</s>[INST] ok [/INST]"))
    return rows


def in_order(rows):
    by = {}
    for c, k, r, x in rows:
        by.setdefault(c, []).append((k is None, k or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


def test_digests(spark, talks):
    df = spark.createDataFrame([(*r, 1, "x") for r in talks], "conv_id long, turn long, role string, text string, ord int, window string")
    made = chat.windows(df)
    want = in_order(talks)
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        lines = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_windows(spark, talks):
    budget = chat.Budget(window=300, history=80)
    made = chat.windows(spark.createDataFrame(talks, "conv_id long, turn long, role string, text string"), budget).collect()
    by = {}
    for w in made:
        by.setdefault(w.conv_id, []).append(w)
    tokens = lambda t: len(t.encode().split()) + budget.per_turn
    for c, turns in in_order(talks).items():
        ws = sorted(by[c], key=lambda w: w.window)
        assert [w.window for w in ws] == list(range(len(ws)))
        system = turns[0] if turns[0][0] == "system" else None
        at = 0
        for w in ws:
            parsed = read(w.formatted)
            assert len(parsed) == w.n_turns
            new = parsed[w.n_repeated :]
            assert new == turns[at : at + len(new)] and new
            again = parsed[: w.n_repeated]
            if system and at > 0:
                assert again[0] == system
                again = again[1:]
            assert again == turns[at - len(again) : at]
            assert sum(tokens(x) for _, x in again) <= budget.history
            if w.over_budget:
                assert len(new) == 1 or system and tokens(system[1]) > budget.window - budget.history - budget.window // 4
            else:
                assert w.n_tokens <= budget.window
            for s in w.loss:
                assert unescape(w.formatted[s["start"] : s["end"]]) in [x for r, x in new if r == "assistant"]
            assert len(w.loss) == sum(r == "assistant" for r, _ in new)
            at += len(new)
        assert at == len(turns)


def unescape(t):
    import re
    return re.sub(r"([<\[])\\" + chat.CONTROL.removeprefix(r"[<\[]"), r"\1\2\3", t)


def read(formatted):
    parts = [p for p in formatted.split(chat.END) if p]
    return [tuple(unescape(y) for y in p.removeprefix(chat.BEGIN).split(chat.MIDDLE)) for p in parts]


def test_no_rows(spark, talks):
    df = spark.createDataFrame(talks[:1], "conv_id long, turn long, role string, text string").limit(0)
    assert chat.windows(df).count() == 0 and chat.digest(chat.windows(df)).count() == 0
