r"""Personal data in whole texts: patterns propose spans, checksums confirm them, nearby words move the score.

Everything is a column expression.  ``split`` gives the text between the matches of a kind and
``regexp_extract_all`` the matches, so the place of a match is a running sum of lengths.  Only candidate
rows (short strings) are shuffled, once, by text; texts stay where they are read.

Base kinds email, ip, card and phone follow fixed patterns and checks and always stay.  The method adds
``iban`` (mod 97) and ``short_card`` (13 to 15 digits, Luhn).  Whole words nearby raise a span's score (``RAISE``)
or lower it (``LOWER``), and an added span stays when its prior and both reach ``THRESHOLD``: a short card needs
a word for it, an iban none against it.  The patterns are the stated ones with possessive
repetition and a look at the character before, which match the same spans in linear time on long runs.

Defined cases: a null text is empty; a null id is kept as it is; every input row gives one row, so repeated
rows give equal rows; a text without spans has zero counts and the digest of the empty text; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shelfmark.llm.common import table

LOCAL = r"[A-Za-z0-9._%+-]"
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)?"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
}
KINDS = ("email", "ip", "card", "phone", "iban", "short_card")
BASE = KINDS[:4]
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.6, "short_card": 0.35}
RAISE = {
    "email": "e?-?mail|contact|write|reach", "ip": "ip|host|server|address|login", "card": "card|visa|mastercard|credit|pay|payment",
    "phone": "tel|telephone|phone|call|fax|mobile", "iban": "iban|bank|account|konto|transfer", "short_card": "card|amex|visa|credit|pay|payment",
}
LOWER = {
    "email": "example|sample|noreply|placeholder", "ip": "version|release|build|section|chapter", "card": "isbn|serial|tracking|order|sample",
    "phone": "isbn|serial|version|sample", "iban": "serial|model|part|batch|sample", "short_card": "isbn|serial|tracking|order|imei|sample",
}
BONUS, MALUS, THRESHOLD = 0.2, 0.2, 0.5
BEFORE, AFTER = 48, 24


def _candidates(text: str, kind: str) -> str:
    pattern = PATTERNS[kind].replace("\\", "\\\\")
    gaps, found = f"split({text}, '{pattern}', -1)", f"regexp_extract_all({text}, '{pattern}', 0)"
    # The characters around a match, across a neighbour of its own kind too.
    before = (
        f"right(concat(if(i > 0, concat(right(get(x.gaps, i - 1), {BEFORE}), right(get(x.found, i - 1), {BEFORE})), ''),"
        f" right(x.gaps[i], {BEFORE})), {BEFORE})"
    )
    after = (
        f"left(concat(left(x.gaps[i + 1], {AFTER}), coalesce(left(get(x.found, i + 1), {AFTER}), ''),"
        f" coalesce(left(get(x.gaps, i + 2), {AFTER}), '')), {AFTER})"
    )
    item = (
        f"named_struct('kind', '{kind}', 'nth', i, 'gap', length(x.gaps[i]), 'match', m,"
        f" 'near', lower(concat({before}, ' ', {after})))"
    )
    empty = "cast(array() as array<struct<kind:string,nth:int,gap:int,match:string,near:string>>)"
    # One struct per kind, so that split and matches are computed once per text.
    return (
        f"aggregate(array(named_struct('gaps', {gaps}, 'found', {found})), {empty},"
        f" (a, x) -> transform(x.found, (m, i) -> {item}))"
    )


def _luhn(digits: str) -> str:
    value = f"int(substring({digits}, -i, 1))"
    doubled = f"({value} * 2 - if({value} > 4, 9, 0))"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + if(i % 2 = 0, {doubled}, {value})) % 10 = 0"


def _mod97(code: str) -> str:
    turned = f"concat(substring({code}, 5), left({code}, 4))"
    step = "if(c < 'A', (a * 10 + int(c)) % 97, (a * 100 + ascii(c) - 55) % 97)"
    return f"aggregate(regexp_extract_all({turned}, '[A-Z0-9]', 0), 0, (a, c) -> {step}) = 1"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``spans``, an array of (rank, start, end, kind, base, score) by kind, then start.

    Places count code points, the end is exclusive.
    """
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = texts.select(
        "row", "id", F.explode_outer(F.expr("concat(" + ", ".join(_candidates("text", k) for k in PATTERNS) + ")")).alias("c")
    ).repartition("row")
    upto = Window.partitionBy("row", "c.kind").orderBy("c.nth")
    length = F.length("c.match")
    digits = F.regexp_replace("match", "[^0-9]", "")
    placed = rows.select(
        "row", "id", "c.match", "c.near", "c.kind", (F.sum(F.col("c.gap") + length).over(upto)).alias("end")
    ).withColumns({"start": F.col("end") - F.length("match"), "digits": digits, "code": F.translate("match", " ", "")})
    n, luhn = F.length("digits"), F.expr(_luhn("digits"))
    kind = (
        F.when(F.col("kind") == "email", "email")
        .when((F.col("kind") == "ip") & F.col("match").rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ip")
        .when((F.col("kind") == "card") & n.between(13, 19), F.when(luhn, F.when(n >= 16, "card").otherwise("short_card")))
        .when((F.col("kind") == "phone") & n.between(8, 15), "phone")
        .when((F.col("kind") == "iban") & F.expr(_mod97("code")), "iban")
    )
    scored = placed.withColumn("kind", kind)
    choose = lambda values: F.element_at(F.create_map(*[F.lit(x) for k in KINDS for x in (k, values[k])]), F.col("kind"))
    # Whole words, or their plurals: "ip" isn't found in "recipe", nor "card" in "scorecard".
    nearby = lambda words: F.expr(
        "case kind " + " ".join(rf"when '{k}' then near rlike '(?<![\\p{{L}}0-9])(?:{words[k]})s?(?![\\p{{L}}0-9])'" for k in KINDS) + " end"
    )
    moved = F.when(nearby(RAISE), BONUS).otherwise(0.0) - F.when(nearby(LOWER), MALUS).otherwise(0.0)
    scored = scored.withColumns({
        "rank": choose({k: i for i, k in enumerate(KINDS)}),
        "base": F.col("kind").isin(*BASE),
        "score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), choose(PRIOR) + moved)), 3),
    })
    stays = F.col("kind").isNotNull() & (F.col("base") | (F.col("score") >= THRESHOLD))
    span = F.when(stays, F.struct("rank", "start", "end", "kind", "base", "score"))
    return scored.groupBy("row", "id").agg(F.sort_array(F.collect_list(span)).alias("spans")).select(
        F.col("id").alias(id_col), "spans"
    )


def op3_pii(spark, sf_dir):
    """Counts, digest of the base spans and all spans of every document."""
    found = find_spans(table(spark, sf_dir, "documents"))
    joined = lambda spans: f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(joined("filter(spans, s -> s.base)")).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined("spans")).alias("spans"),
        F.expr("array_join(transform(spans, s -> cast(s.score as string)), ',')").alias("scores"),
    )
