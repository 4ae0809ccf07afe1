import hashlib
import random
import re

from weft.llm.chat import BUDGET, HISTORY, HISTORY_TOKENS, digests, windows


def rows():
    rng = random.Random(6)
    bits = ["\\", "<|", "<|end|>", "|>", "\\s", "\\l|", "é日", "\U0001f600", " ", "\n", "word", "12", "###", "x"]
    out = []
    for conv in range(30):
        turn = 0
        if conv % 3 == 0:
            out.append((conv, turn, "system", "be kind <|end|> \\"))
            turn += 1
        for _ in range(rng.choice([0, 1, 2, 7, 40, 600 if conv == 4 else 3])):
            out.append((conv, turn, ["user", "assistant", "tool|\\p"][rng.randrange(3)], "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 40, 200])))))
            turn += 1
    out += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (500, 0, "assistant", None), (None, 0, "user", "n"), (501, None, None, "z"), (501, 2, "assistant", "a " * 3000)]
    rng.shuffle(out)
    return out


def grouped(data):
    convs = {}
    for c, t, r, x in data:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: sorted(v) for c, v in convs.items()}


def test_digests_read_back(spark):
    data = rows()
    frame = spark.createDataFrame([(*r, "x") for r in data], "conv_id long, turn long, role string, text string, key string")
    got = {r.conv_id: r for r in digests(frame).collect()}
    want = grouped(data)
    assert set(got) == set(want)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in want.items():
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss)), c
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for *_, r, x in turns))
        assert got[c].loss_sha256 == sha(loss)


def test_windows_keep_their_budget(spark):
    data = [r for r in rows() if r[0] is not None]
    got = windows(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()
    want = grouped(data)
    for conv, turns in want.items():
        own = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.first_turn)
        assert [r.first_turn for r in own] == [1 + sum(x.n_turns for x in own[:i]) for i in range(len(own))]
        system = next((i for i, t in enumerate(turns) if t[2] == "system"), None)
        for r in own:
            parts = r.text.split("<|end|>")[:-1]
            assert len(parts) == r.n_repeated + r.n_turns
            assert r.tokens <= BUDGET or r.n_turns == 1
            if system is not None and r.first_turn > system + 1:
                assert parts[0].startswith("<|system|>")
            assert r.n_repeated <= HISTORY + 1
            assert all(r.text[s.start - 2 : s.start] == "|>" and r.text[s.end : s.end + 7] == "<|end|>" for s in r.loss)
            assert all(s.start >= sum(len(p) + 7 for p in parts[: r.n_repeated]) for s in r.loss)
    assert any(r.n_repeated for r in got) and HISTORY_TOKENS < BUDGET


def test_empty(spark):
    assert digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_the_plan_has_no_python(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert not re.search("Python|Pandas|Arrow", digests(frame)._jdf.queryExecution().executedPlan().toString().replace("ArrowEvalNothing", ""))


def test_long_system_turns_stay_in_the_budget(spark):
    """A system turn, long or not, never pushes a window over the budget."""
    word = lambda n: " ".join(["w"] * n)
    for size in (40, 200, 253, 254, 400, 600):
        data = [(1, 0, "system", word(size))] + [(1, i, "assistant" if i % 2 else "user", word(40 if i % 7 else 430)) for i in range(1, 600)]
        got = windows(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()
        assert sum(r.n_turns for r in got) == 600
        for r in got:
            assert r.tokens <= BUDGET or (r.n_turns == 1 and r.n_repeated == 0), (size, r.tokens, r.n_turns)
        again = [r for r in got if r.text.startswith("<|system|>") and r.first_turn > 1]
        assert bool(again) == (size + 3 <= BUDGET // 2)
        if again:
            assert max(r.first_turn for r in again) > 512


def test_names_ties_and_repeated_rows(spark):
    data = [("b", 0, "user", "z"), ("b", 0, "user", "a"), ("b", 0, "user", "a"), ("null", 0, "assistant", "x"), (None, 0, "assistant", "y")]
    frame = spark.createDataFrame(data, "conv_id string, turn long, role string, text string")
    got = {r.conv_id: r for r in digests(frame).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {"b", "null", None} and got["b"].n_turns == 3
    assert got["b"].turns_sha256 == sha("user\na\nuser\na\nuser\nz\n")
    assert got["null"].loss_sha256 == sha("x") and got[None].loss_sha256 == sha("y")


def test_the_text_is_shuffled_once(spark):
    frame = spark.createDataFrame([(c, t, "user", "a b") for c in range(5) for t in range(4)], "conv_id long, turn long, role string, text string")
    plan = digests(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
