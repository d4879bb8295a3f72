import random

from shelfmark.llm import preference
from tests.llm.helpers import plain

SCHEMA = "pair long, side string, turn long, role string, text string, split long, rendered string, of long, part string"


def brute(rows):
    by_pair = {}
    for pair, side, turn, role, text, *_ in rows:
        two = by_pair.setdefault(pair, {"chosen": set(), "rejected": set()})
        two["chosen" if side == "chosen" else "rejected"].add((turn, role if role is not None else "unknown", text or ""))
    show = lambda s: s.replace("<|", "<​|").replace("|>", "|​>")
    out = []
    for pair, two in by_pair.items():
        differing = [t for t, _, _ in two["chosen"] ^ two["rejected"] if t is not None]
        split = min(differing, default=None)
        for turn, role, text in two["chosen"] | two["rejected"]:
            common = turn is not None and (split is None or turn < split)
            parts = ["prompt"] if common else [s for s in two if (turn, role, text) in two[s]]
            for part in parts:
                out.append((pair, part, turn, role, f"<|{show(role)}|>\n{show(text)}<|end|>\n", part != "prompt" and role == "assistant"))
    return plain(out)


def run(spark, rows):
    return plain(preference.format_preferences(spark.createDataFrame(rows, SCHEMA)).collect())


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for pair in range(60):
        common = rng.randrange(6)
        for side in ("chosen", "rejected"):
            for t in range(rng.randrange(common, 9)):
                rows.append((pair, side, t, "user" if t % 2 == 0 else "assistant", f"t{t}" if t < common else rng.choice("abc")))
    rows += [(100, "chosen", 0, None, None), (100, "rejected", 0, None, None), (100, "chosen", None, "assistant", "x"), (100, "rejected", 3, "user", "")]
    rows += [(101, "chosen", 0, "user", "<|end|> |> <|assistant|>")] * 3 + [(102, "rejected", 5, "assistant", "long " * 50_000)]
    rows += [(None, "chosen", 0, "user", "a"), (None, "rejected", 0, "user", "a"), (None, "rejected", 1, "assistant", "b")]
    rows += [(103, s, 0, "user", t) for s in ("chosen", "rejected") for t in "ab"] + [(103, "chosen", 1, "assistant", "z")]
    rows = [(*r, 1, "x", 2, "y") for r in rows]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_prompt_is_rendered_once(spark):
    rows = [(1, s, t, r, x, 0, "", 0, "") for s, last in (("chosen", "good"), ("rejected", "bad"))
            for t, (r, x) in enumerate([("user", "q"), ("assistant", "a"), ("user", "q2"), ("assistant", last)])]
    got = run(spark, rows)
    assert [g[1] for g in got].count("prompt") == 3 and [g[5] for g in got].count(True) == 2
