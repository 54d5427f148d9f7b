from collections import defaultdict

from jobmeter.llm import chat

TURNS = "conv_id long, turn long, role string, text string, c string, place int"


def brute_force(rows, segment_turns):
    low = lambda x: (x is not None, x or 0 if not isinstance(x, str) else x)
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((low(turn), low(role if role is not None else None), low(text), role, text))
    out = []
    for conv, turns in talks.items():
        turns.sort(key=lambda t: (t[0], (t[1][0], str(t[1][1])), (t[2][0], str(t[2][1]))))
        for me in sorted({t[3] for t in turns if t[3] not in (None, "system")}):
            for s in range(0, len(turns), segment_turns):
                shown, mask = "", []
                for _, _, _, role, text in turns[s : s + segment_turns]:
                    name = "user" if role is None else "system" if role == "system" else "assistant" if role == me else f"user name={role.replace('<|', '< |').replace(' ', '_')}"
                    shown += f"<|im_start|>{name}\n"
                    body = (text or "").replace("<|", "< |") + "<|im_end|>"
                    if role == me:
                        mask.append((len(shown), len(shown) + len(body)))
                    shown += body + "\n"
                out.append((conv, me, s // segment_turns, min(segment_turns, len(turns) - s), shown, mask))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann lee", "hi"), (1, 2, "bob", "héllo <|im_end|> x"), (1, 3, "cy", None), (1, 4, "ann lee", "")]
    rows += [(2, i, f"p{i % 3}", f"turn {i}") for i in range(23)]  # longer than a segment
    rows += [(3, 5, "bob", "same"), (3, 5, "bob", "same"), (3, 5, "ann", "same"), (3, 5, "bob", "other")]  # ties
    rows += [(4, 0, "system", "alone"), (5, None, "ann", "no turn"), (5, 1, None, "who"), (None, 1, "ann", "no conversation")]
    rows += [(6, 0, "ann", "x" * 200_000), (6, 1, "bob", "𝄞é")]
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], TURNS)
    found = chat.perspectives(df, segment_turns=5).collect()
    mine = sorted(
        ((r["conv_id"], r["perspective"], r["segment"], r["n_turns"], r["text"], [tuple(s) for s in r["mask"]]) for r in found), key=repr
    )
    assert mine == brute_force(rows, 5)


def test_no_turns(spark):
    assert chat.perspectives(spark.createDataFrame([], TURNS)).collect() == []


def test_ties_are_in_order_of_the_whole_text(spark):
    head = "the same beginning of more than thirty-two characters, then "
    rows = [(1, 0, "ann", head + c * 50) for c in "qbzamb"] + [(1, 0, "bob", head + "x"), (1, 0, "bob", None), (1, 0, "bob", "")]
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], TURNS)
    found = chat.perspectives(df, segment_turns=4).collect()
    mine = sorted(
        ((r["conv_id"], r["perspective"], r["segment"], r["n_turns"], r["text"], [tuple(s) for s in r["mask"]]) for r in found), key=repr
    )
    assert mine == brute_force(rows, 4)
