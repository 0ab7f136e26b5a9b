import random

from tyscope.llm import preference as P


def render(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def brute(chosen, rejected):
    out = {}
    for k in chosen.keys() | rejected.keys():
        a, b = chosen.get(k, []), rejected.get(k, [])
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        texts, masks = [], []
        for turns in (a[n:], b[n:]):
            s, spans = "", []
            for role, text in turns:
                begin = len(s) + len(f"<|im_start|>{role}\n")
                s += render(role, text)
                if role == "assistant":
                    spans.append(f"{begin}:{len(s)}")
            texts.append(s)
            masks.append(",".join(spans))
        out[k] = (n, "".join(render(*t) for t in a[:n]), *texts, *masks)
    return out


def conversations(seed):
    rnd = random.Random(seed)
    shared = random.Random(7)
    rows, plain = [], {}
    for c in range(40):
        base = [(shared.choice(["user", "assistant", "system"]), shared.choice(["é one", "two\n", "", "𝄞 three"])) for _ in range(6)]
        turns = base[:rnd.randrange(7)] + [(rnd.choice(["user", "assistant"]), str(rnd.randrange(3))) for _ in range(rnd.randrange(3))]
        if turns:
            plain[c] = turns
            rows += [(c, i * 2, r, t, c) for i, (r, t) in enumerate(turns)]
    rnd.shuffle(rows)
    return rows, plain


def test_against_brute_force(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, prompt bigint"
    (a, pa), (b, pb) = conversations(1), conversations(2)
    got = P.format_pairs(P.positions(spark.createDataFrame(a, schema)), P.positions(spark.createDataFrame(b, schema))).collect()
    assert {r.pair_id: tuple(r)[1:] for r in got} == brute(pa, pb)
    assert any(r.prompt_turns for r in got) and any(not r.prompt_turns for r in got)


def test_nulls_ties_and_repeats(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(1, None, "user", "last"), (1, 0, None, None), (1, 0, "assistant", "x"), (1, 0, "assistant", "x"), (None, 0, "user", "lost"),
            (2, 0, "assistant", "y" * 100_000)]
    turns = P.positions(spark.createDataFrame(rows, schema))
    want = {1: [("", ""), ("assistant", "x"), ("assistant", "x"), ("user", "last")], 2: [("assistant", "y" * 100_000)]}
    assert {r.pair_id: tuple(r)[1:] for r in P.format_pairs(turns, turns).collect()} == brute(want, want)
    weak = {1: [("", ""), ("assistant", "x"), ("assistant", "")], 2: [("assistant", "y" * 50_000)]}
    assert {r.pair_id: tuple(r)[1:] for r in P.format_pairs(turns, P.weakened(turns)).collect()} == brute(want, weak)
    assert P.format_pairs(turns.limit(0), turns.limit(0)).count() == 0
