import hashlib
import random
import re

import pytest

from shelfmark.llm import pii
from tests.llm.helpers import awkward, frame

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def noise(rng):
    """Strings dense in near misses: every character matters to some pattern."""
    return "".join(rng.choice("ab1290.@+-() _%é😀") for _ in range(rng.randrange(200)))


def found(spark, rows):
    got = pii.find_spans(frame(spark, rows, extra=True)).collect()
    return sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"], s["base"]) for s in r["spans"]]) for r in got), key=str)


def test_base_equals_plain_search(spark):
    rng = random.Random(5)
    texts = [noise(rng) for _ in range(400)]
    texts += ["a@b.com_x@y.org", "me.@x-y.z.w,", "1.2.3.4.5.6.7.8", "0001.2.3.255 999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
              "+1 (555) 010-9999 +1-2", "+1+1234567+12 34 56 78 9", "é😀x@y.zz 10.0.0.1", "a@" + "b." * 5000 + "c", "1" * 50_000,
              "1 " * 30_000, "x" * 60_000 + "@", "1." * 20_000, "+1" + "(" * 20_000]
    rows = awkward() + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(texts)]
    want = sorted(((r[0], base_spans(r[1])) for r in rows), key=str)
    got = [(i, [f"{k}:{a}:{b}" for k, a, b, base in spans if base]) for i, spans in found(spark, rows)]
    assert sorted(got, key=str) == want


def test_method_adds_confirmed_spans(spark):
    rows = [
        (1, "IBAN DE89 3704 0044 0532 0130 00 please", "", "", 0), (2, "IBAN DE89 3704 0044 0532 0130 01 please", "", "", 0),
        (3, "GB82WEST12345698765432", "", "", 0), (4, "amex card 378282246310005", "", "", 0), (5, "number 378282246310005", "", "", 0),
    ]
    kinds = {i: [s[0] for s in spans] for i, spans in found(spark, rows)}
    assert kinds[1] == ["iban"] and kinds[3] == ["iban"] and kinds[4] == ["short_card"]
    assert "iban" not in kinds[2] and kinds[5] == []


def test_words_nearby_decide_added_spans(spark):
    """Whole words raise or lower a score; base spans stay whatever is near them."""
    iban, amex, card = "DE89 3704 0044 0532 0130 00", "378282246310005", "4111111111111111"
    texts = [
        iban, f"iban {iban}", f"serial {iban}", f"bank serial {iban}", f"serials {iban}", f"serialised {iban}",
        f"scorecard {amex}", f"cards: {amex}", f"pay order {amex}", f"order {card}", f"visa {card}", "version ip 1.2.3.4", "recipe 1.2.3.4",
        f"card {amex} {amex}", f"{amex} then {amex} card",
    ]
    got = pii.find_spans(frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)])).collect()
    spans = {r["doc_id"]: [(s["kind"], s["score"]) for s in r["spans"]] for r in got}
    assert [spans[i] for i in range(6)] == [
        [("iban", 0.6)], [("iban", 0.8)], [], [("iban", 0.6)], [], [("iban", 0.6)],
    ]
    assert [spans[i] for i in (6, 7, 8)] == [[], [("short_card", 0.55)], []]
    assert [spans[i] for i in range(9, 13)] == [[("card", 0.6)], [("card", 1.0)], [("ip", 0.6)], [("ip", 0.6)]]
    # A word is near across a neighbour of the same kind, too.
    assert [len(spans[i]) for i in (13, 14)] == [2, 2]


def test_query_columns(spark, tmp_path):
    frame(spark, awkward()).write.parquet(str(tmp_path / "documents.parquet"))
    rows = pii.op3_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        assert r["base_sha256"] == hashlib.sha256(",".join(x for x in r["spans"].split(",") if x).encode()).hexdigest()
    frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pii.op3_pii(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("digits, ok", [("4111111111111111", True), ("4111111111111112", False), ("0000000000000000", True)])
def test_luhn(digits, ok):
    assert luhn(digits) == ok
