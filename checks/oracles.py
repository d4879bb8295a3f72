"""The same results in DuckDB SQL, written independently of the Spark code."""

from __future__ import annotations

from checks.fixtures import LATIN_TOPICS, LATIN_TYPES, LATIN_UNITS
from shelfmark.functions import lexicon

SPACE = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HAN = r"[\x{4e00}-\x{9fff}]"
EDGE = r"[^\p{L}\p{N}_]"

OFFERS_PART = """
offers as (
  select p_partkey as row_id, p_name as title, cast(null as varchar) as description,
    case when p_size % 10 = 0 then '-' else p_brand || ' / ' || p_name end as shop_category_name,
    case when p_size % 7 = 0 then 'no brand' else p_brand end as vendor_name,
    case when p_size % 5 = 0 then null
         else cast(cast(round(p_retailprice * 10) as bigint) as varchar) end as vendor_code,
    category_id, category_id % 3 as department_id
  from (select *, dense_rank() over (order by p_type) as category_id from part))"""

OFFERS_DOCS = """
offers as (
  select doc_id as row_id, text as title, text as description,
    case when doc_id % 3 = 0 then null else lang || ' / ' || source end as shop_category_name,
    source as vendor_name, cast(null as varchar) as vendor_code,
    100 * department_id + cast(regexp_extract(source, '([0-9]+)', 1) as bigint) as category_id,
    department_id
  from (select *, dense_rank() over (order by lang) as department_id from documents))"""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x):
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def han(x):
    return f"regexp_matches({x}, '{HAN}')"


def kept(x):
    return rf"trim(regexp_replace({x}, '[^a-zа-я0-9\-]+', ' ', 'g'))"


def untag(x):
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def clean_text(x):
    return kept(untag(f"lower(coalesce({x}, ''))"))


def clean_desc(x, n=1500):
    t = f"regexp_replace(coalesce({x}, ''), '<br{SPACE}*/?>', chr(10), 'gi')"
    t = rf"regexp_replace({untag(t)}, '\\[rn]+', chr(10), 'g')"
    return kept(f"lower(substr({t}, 1, {n}))")


def vendor(x):
    name = f"lower({strip(x)})"
    brands = ", ".join(q(b) for b in lexicon.NO_BRAND)
    return f"case when {x} is null or {han(name)} or {name} in ({brands}) then '' else {clean_text(x)} end"


def leaf(x):
    last = strip(f"string_split({x}, ' / ')[-1]")
    return (
        f"case when {x} is null or {strip(x)} in ('', '-') or len(string_split({x}, ' / ')) < 2 then '' "
        f"when {han(last)} then '' else {last} end"
    )


def shop_category(x):
    return f"case when {x} is null or {strip(x)} in ('', '-') or {han(x)} then '' else {clean_text(x)} end"


def department_scn(x):
    s = strip(f"coalesce({x}, '')")
    return f"case when {s} in ('-', 'nan', '') or {han(s)} then '' else {s} end"


def words_of(title):
    return f"regexp_extract_all(lower(coalesce({title}, '')), '[a-zа-я0-9]+')"


def pattern(p):
    """RE2 has ASCII word edges only, so they are spelt out."""
    if p.startswith(r"\b"):
        p = f"(?:^|{EDGE})" + p[2:]
    return p.replace(r"\b", f"(?:$|{EDGE})").replace(r"\d", r"\p{Nd}").replace(r"\s", SPACE)


def flags(x, table):
    return ", ".join(f"case when regexp_matches({x}, {q(pattern(p))}) then '{t}' end" for t, p in table)


def joined(*items):
    return f"array_to_string(list_filter([{', '.join(items)}], lambda t: t is not null), ' ')"


def title_tokens(x, units=lexicon.UNIT_FLAGS, types=lexicon.TYPE_FLAGS):
    w = words_of(x)
    heads = [
        f"case when len({w}) >= 1 then '__fw_' || {w}[1] || '__' end",
        f"case when len({w}) >= 2 then '__bg_' || {w}[1] || '_' || {w}[2] || '__' end",
    ]
    found = joined(*heads, flags(f"lower({x})", units), flags(f"lower({x})", types))
    return f"case when {x} is null or {x} = '' then '' else {found} end"


def description_tokens(x, table=lexicon.DESCRIPTION_FLAGS):
    d = f"lower({untag(x)})"
    size = f"case when length({d}) < 100 then '__desc_short__' when length({d}) > 2000 then '__desc_long__' end"
    return f"case when {x} is null or {x} = '' then '__no_desc__' else {joined(flags(d, table), size)} end"


def times(x, n):
    return f"repeat(({x}) || ' ', {n})"


def nan(x):
    return f"coalesce({x}, 'nan')"


CATEGORY_TEXT = " || ".join([
    times(clean_text("title"), 4), times(shop_category("shop_category_name"), 2),
    times(clean_text(leaf("shop_category_name")), 3), times(title_tokens("title"), 3),
    times(vendor("vendor_name"), 1), times(clean_desc("description"), 1),
    f"({description_tokens('description')})",
])
RESELLERS = "jiemiwl|jiemi|romiky|juxiang|linglin|muzimao|qingye"
WORD_TEXT = " || ".join([
    times(clean_text(department_scn("shop_category_name")), 6),
    times(clean_text(leaf("shop_category_name")), 3), times(clean_text("title"), 2),
    times(title_tokens("title"), 1), times(clean_text(nan("vendor_name")), 1),
    times(clean_desc(nan("description"), 800), 1),
    f"case when regexp_matches(lower({nan('vendor_code')}), '{RESELLERS}') then '' else {nan('vendor_code')} end",
])
CHAR_TEXT = " || ' ' || ".join([
    f"lower({department_scn('shop_category_name')})",
    f"substr(lower({nan('title')}), 1, 300)", f"substr(lower({nan('vendor_name')}), 1, 50)",
    f"substr(lower({nan('vendor_code')}), 1, 30)",
])


def key(a, b):
    def norm(x):
        return strip(f"lower(coalesce({x}, ''))")
    return f"{norm(a)} || '|||' || {norm(b)}"


TITLE_VENDOR = key("title", "vendor_name")
TITLE_SCN = key("title", "shop_category_name")
USABLE = f"shop_category_name is not null and {strip('shop_category_name')} not in ('', '-')"


def rule(k, where="true", label="category_id", source="offers"):
    return (
        f"select {k} as key, min({label}) as {label} from {source} where {where} "
        f"group by 1 having count(distinct {label}) = 1"
    )


RULES = f"""
vc as ({rule('vendor_code', 'vendor_code is not null', source='train')}),
sc as ({rule('shop_category_name', USABLE, source='train')}),
tv as ({rule(TITLE_VENDOR, source='train')}),
ts as ({rule(TITLE_SCN, source='train')})"""


KNOWN = "known as (select category_id, arg_min(department_id, row_id) as department_id from train group by 1)"


def applied(source):
    return f"""
applied as (
  select row_id, coalesce(vc.category_id, sc.category_id, tv.category_id, ts.category_id) as rule_category
  from (select *, {TITLE_VENDOR} as k_tv, {TITLE_SCN} as k_ts from {source}) o
  left join vc on vc.key = o.vendor_code left join sc on sc.key = o.shop_category_name
  left join tv on tv.key = o.k_tv left join ts on ts.key = o.k_ts)"""


def split(source="offers"):
    """train and held tables: the lowest 15 % of the hashes of each department."""
    return f"""
flagged as (
  select *, row_number() over (partition by department_id order by md5('42:' || row_id), row_id)
    <= floor(count(*) over (partition by department_id) * cast(0.15 as double) + 0.5) as held_out
  from {source}),
train as (select * exclude (held_out) from flagged where not held_out),
held as (select * exclude (held_out) from flagged where held_out)"""


WORD = r"[\p{L}\p{N}_]{2,}"


def word_counts(text, source, high, name):
    grams = "l"
    if high >= 2:
        grams = f"list_concat({grams}, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]))"
    if high >= 3:
        grams = (
            f"list_concat({grams}, list_transform(range(1, len(l) - 1), "
            "lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]))"
        )
    return f"""
{name}_counts as (
  select row_id, term, count(*) as tf
  from (select row_id, unnest({grams}) as term
        from (select row_id, regexp_extract_all(lower({text}), '{WORD}') as l from {source}))
  group by 1, 2)"""


def char_counts(text, source, name):
    grams = "list_concat(" + ", ".join(
        f"list_transform(range(1, length(w) - {n} + 2), lambda i: substr(w, i, {n}))" for n in (3, 4, 5)
    ) + ")"
    return f"""
{name}_counts as (
  select row_id, term, count(*) as tf
  from (select row_id, unnest({grams}) as term
        from (select row_id, ' ' || unnest(list_filter(regexp_split_to_array(lower({text}), '{SPACE}+'),
                lambda w: w <> '')) || ' ' as w from {source}))
  group by 1, 2)"""


def corpus(name):
    return f"select term, count(*) as df, sum(tf)::bigint as ctf from {name}_counts group by 1"


def vocabulary(name, n, source, min_df=1):
    return f"""
{name}_vocab as (
  select term, df, ctf, ln((1.0 + (select count(*) from {source})) / (1.0 + df)) + 1.0 as idf
  from ({corpus(name)} having count(*) >= {min_df}) order by ctf desc, term limit {n})"""


def tfidf(name):
    return f"""
{name}_raw as (
  select c.row_id, c.term, (1.0 + ln(c.tf)) * v.idf as raw
  from {name}_counts c join {name}_vocab v on c.term = v.term),
{name}_tfidf as (
  select row_id, term, raw / sqrt(sum(raw * raw) over (partition by row_id)) as weight from {name}_raw)"""


CATEGORY_DOCS = f"docs as (select row_id, {CATEGORY_TEXT} as text from offers)"
WORD_DOCS = f"docs as (select row_id, {WORD_TEXT} as text from offers)"
CHAR_DOCS = f"docs as (select row_id, {CHAR_TEXT} as text from offers)"

# Category vectors of the hold-out against the rest, with margins of +1 for the
# offer's own department and -1 for the others in place of the classifier.
KNN_TEXT = f"""
with {OFFERS_DOCS}, {split()},
train_docs as (select row_id, {CATEGORY_TEXT} as text from train),
held_docs as (select row_id, {CATEGORY_TEXT} as text from held),
{word_counts('text', 'train_docs', 2, 't')}, {vocabulary('t', 50000, 'train_docs')}, {tfidf('t')},
{word_counts('text', 'held_docs', 2, 'h')},
h_vocab as (select * from t_vocab), {tfidf('h')},
departments as (select distinct department_id from train),
p as (
  select row_id, department_id, e / sum(e) over (partition by row_id) as p
  from (select h.row_id, d.department_id,
          exp(case when h.department_id = d.department_id then 1.0 else -1.0 end) as e
        from held h, departments d)),
cosines as (
  select h.row_id as q, t.row_id as t, sum(h.weight * t.weight) as cosine
  from h_tfidf h join t_tfidf t on h.term = t.term group by 1, 2)"""


def best(factor="1.0", extra=""):
    return f"""
scored as (
  select c.q, c.t, train.category_id, c.cosine * p.p * {factor} as score
  from cosines c join train on train.row_id = c.t
  join p on p.row_id = c.q and p.department_id = train.department_id {extra}),
picked as (
  select q, category_id from (
    select *, row_number() over (partition by q order by round(score / top, 12) desc, t) as r
    from (select *, max(score) over (partition by q) as top from scored) where top > 0)
  where r = 1),
predicted as (
  select held.row_id, coalesce(picked.category_id,
      (select category_id from train order by row_id limit 1)) as category_id
  from held left join picked on picked.q = held.row_id)"""


PRIOR_KEY = strip("coalesce(shop_category_name, '')")
PRIOR = f"""
pairs as (
  select {PRIOR_KEY} as scn, category_id, count(*) as n from train
  where {USABLE} and {PRIOR_KEY} <> 'nan' group by 1, 2),
totals as (select scn, sum(n) as total from pairs group by 1),
k as (select count(distinct category_id) as k from train)"""
PRIOR_FACTOR = (
    "pow(case when pairs.n is not null then (pairs.n + 1.0) / (totals.total + (select k from k)) "
    "when totals.total is not null then 1.0 / (totals.total + (select k from k)) "
    "else 1.0 / (select k from k) end, 0.3)"
)
PRIOR_JOIN = (
    f"join (select row_id, {PRIOR_KEY} as scn from held) s on s.row_id = c.q "
    "left join totals on totals.scn = s.scn "
    "left join pairs on pairs.scn = s.scn and pairs.category_id = train.category_id"
)

# Four department scores of an embedding: the sums of 16 components each.
QUARTERS = (
    "list_transform(range(0, 4), lambda k: list_sum(list_transform(embedding[16 * k + 1:16 * k + 16], "
    "lambda x: cast(x as double))))"
)

KNN_DENSE = f"""
with rows_ as (
  select vec_id as row_id, cast(label as bigint) as category_id, cast(label % 4 as bigint) as department_id, embedding
  from embeddings),
{split('rows_')},
terms as (
  select row_id, 2 * i + case when v > 0 then 0 else 1 end as i, abs(v) / sqrt(sum(v * v) over (partition by row_id)) as weight
  from (select row_id, unnest(range(0, 64)) as i, cast(unnest(embedding) as double) as v from rows_) where v <> 0),
p as (
  select row_id, department_id, e / sum(e) over (partition by row_id) as p
  from (select row_id, unnest(range(0, 4)) as department_id,
          exp(unnest({QUARTERS})) as e from held)),
cosines as (
  select a.row_id as q, b.row_id as t, sum(a.weight * b.weight) as cosine
  from terms a join held on held.row_id = a.row_id join terms b on a.i = b.i
  join train on train.row_id = b.row_id group by 1, 2), {best()},
result as (
  select predicted.row_id, held.category_id, held.department_id, predicted.category_id as predicted_category,
    cast(predicted.category_id % 4 as bigint) as predicted_department
  from predicted join held on held.row_id = predicted.row_id)"""


def classes(truth, prediction):
    return f"""
labels_ as (select {truth} as label from result union select {prediction} from result),
per_class as (
  select label,
    case when np > 0 then hits / np else 0.0 end as precision,
    case when ns > 0 then hits / ns else 0.0 end as recall,
    2.0 * hits / (np + ns) as f1, ns as support
  from (select l.label, (select count(*) from result where {truth} = l.label) as ns,
          (select count(*) from result where {prediction} = l.label) as np,
          (select count(*) from result where {truth} = l.label and {prediction} = l.label) as hits
        from labels_ l))"""


def oracle_sql() -> dict[str, str]:
    missing = ", ".join(q(m) for m in lexicon.MISSING_STRINGS)
    samples = ["", "NA", "n/a", "null", "None", "007", "nan", "<NA>", "x1", "#N/A", "-"]
    cases = " ".join(f"when {i} then {q(s)}" for i, s in enumerate(samples))
    out = {
        "na_normalize": f"""
with {OFFERS_PART}, injected as (
  select row_id, title, case row_id % 12 {cases} else vendor_code end as code from offers)
select row_id, title, case when code in ({missing}) then null else code end as vendor_code from injected""",
        "clean_text": f"""
select 'pages' as origin, page_id as id, {clean_text('html')} as cleaned from pages
union all select 'documents', doc_id, {clean_text('text')} from documents""",
        "clean_desc": f"""
select 'pages' as origin, page_id as id, {clean_desc('html')} as long_cut, {clean_desc('html', 800)} as short_cut from pages
union all select 'documents', doc_id, {clean_desc('text')}, {clean_desc('text', 800)} from documents""",
        "lemma_join": f"""
with w as (select doc_id, unnest(string_split({clean_text('text')}, ' ')) as word,
        generate_subscripts(string_split({clean_text('text')}, ' '), 1) as pos from documents)
select doc_id as row_id,
  string_agg(case when length(word) >= 5 then left(word, length(word) - 2) else word end, ' ' order by pos) as lemmatised
from w group by 1""",
        "lemma_unknown": f"""
with w as (select doc_id, unnest(string_split({clean_text('text')}, ' ')) as word,
        generate_subscripts(string_split({clean_text('text')}, ' '), 1) as pos from documents),
v as (select distinct word from w where word <> ''),
d as (select word, case when length(word) >= 5 then left(word, length(word) - 2) else word end as lemma
      from v where (length(word) + ascii(word)) % 5 <> 0),
r as (select word, case when starts_with(word, lemma) then length(word) - length(lemma) end as cut from d),
e as (select right(word, n) as ending, cut, count(*) as words from r, range(1, 6) t(n) where n >= cut and n < length(word) group by all),
b as (select ending, arg_min(cut, (-words, cut)) as cut from e group by 1),
u as (select word, arg_max(left(word, length(word) - cut), n) as lemma
      from (select word, n, cut from v, range(1, 6) t(n), b where n < length(word) and b.ending = right(word, n))
      where not regexp_matches(word, '[0-9]') and word not in (select word from d) group by 1),
f as (select * from d union all select * from u)
select doc_id as row_id, string_agg(coalesce(lemma, w.word), ' ' order by pos) as lemmatised
from w left join f on f.word = w.word group by 1""",
        "vendor_clean": f"with {OFFERS_PART} select row_id, {vendor('vendor_name')} as vendor from offers",
        "category_leaf": f"with {OFFERS_PART} select row_id, {leaf('shop_category_name')} as leaf from offers",
        "shop_category_clean": f"""with {OFFERS_PART} select row_id, {shop_category('shop_category_name')} as category_field,
{department_scn('shop_category_name')} as department_field from offers""",
        "title_head_tokens": f"""with {OFFERS_DOCS} select row_id,
case when len({words_of('title')}) >= 1 then '__fw_' || {words_of('title')}[1] || '__' end as first_word,
case when len({words_of('title')}) >= 2 then '__bg_' || {words_of('title')}[1] || '_' || {words_of('title')}[2] || '__' end as first_two
from offers""",
        "flag_tokens": f"""with {OFFERS_DOCS} select row_id, {title_tokens('title')} as tokens,
{title_tokens('title', LATIN_UNITS, LATIN_TYPES)} as latin_tokens from offers""",
        "desc_tokens": f"""with {OFFERS_DOCS} select row_id, {description_tokens('description')} as tokens,
{description_tokens('description', LATIN_TOPICS)} as latin_tokens from offers""",
        "category_text": f"with {OFFERS_DOCS} select row_id, {CATEGORY_TEXT} as category_text from offers",
        "department_word_text": f"with {OFFERS_DOCS} select row_id, {WORD_TEXT} as department_word_text from offers",
        "department_char_text": f"with {OFFERS_DOCS} select row_id, {CHAR_TEXT} as department_char_text from offers",
        "rule_vendor_code": f"with {OFFERS_PART} {rule('vendor_code', 'vendor_code is not null')}",
        "rule_scn": f"with {OFFERS_PART} {rule('shop_category_name', USABLE)}",
        "rule_scn_department": f"with {OFFERS_PART} {rule('shop_category_name', USABLE, 'department_id')}",
        "rule_title_vendor": f"with {OFFERS_PART} {rule(TITLE_VENDOR)}",
        "rule_title_scn": f"with {OFFERS_PART} {rule(TITLE_SCN)}",
        "category_department": f"""with {OFFERS_PART}
select category_id, arg_min(department_id, row_id) as department_id from offers group by 1""",
        "modal_category": f"""with {OFFERS_PART}
select category_id, count(*) as n from offers group by 1 order by n desc, category_id limit 1""",
        "apply_rules": f"with {OFFERS_PART}, {split()}, {RULES}, {applied('held')} select * from applied",
        "rule_coverage": f"""with {OFFERS_PART}, train as (select * from offers), {RULES}, {applied('train')}
select count(*) as n_rows, count(rule_category) as n_covered,
  round(avg(case when rule_category is null then 0.0 else 1.0 end), 6) as share from applied""",
        "dedup_first": f"""with {OFFERS_DOCS} select row_id, title, vendor_name, category_id from (
  select *, row_number() over (partition by title, description, shop_category_name, category_id, department_id
    order by row_id) as r from offers) where r = 1""",
        "stratified_split": f"with {OFFERS_DOCS}, {split()} select row_id, department_id, held_out from flagged",
        "split_counts": f"""with {OFFERS_DOCS}, {split()} select held_out, count(*) as n_rows,
count(distinct department_id) as n_departments, count(distinct category_id) as n_categories from flagged group by 1""",
        "known_category_semi": f"""with {OFFERS_DOCS}, {split()} select row_id, category_id from held
where category_id in (select category_id from train)""",
        "label_lists": f"""with {OFFERS_DOCS} select 'department' as kind, department_id as id, count(*) as n from offers group by 2
union all select 'category', category_id, count(*) from offers group by 2""",
        "word_ngrams": f"with {OFFERS_DOCS}, {CATEGORY_DOCS}, {word_counts('text', 'docs', 2, 'a')} {corpus('a')}",
        "char_wb_ngrams": f"with {OFFERS_DOCS}, {CHAR_DOCS}, {char_counts('text', 'docs', 'a')} {corpus('a')}",
        "vocab_top_n": f"""with {OFFERS_DOCS}, {CATEGORY_DOCS}, {word_counts('text', 'docs', 2, 'a')},
{vocabulary('a', 50000, 'docs')} select term, df, ctf from a_vocab""",
        "idf": f"""with {OFFERS_DOCS}, {CHAR_DOCS}, {char_counts('text', 'docs', 'a')},
{vocabulary('a', 50000, 'docs', 2)} select term, df, round(idf, 6) as idf from a_vocab""",
        "tfidf_l2": f"""with {OFFERS_DOCS}, {CATEGORY_DOCS}, {word_counts('text', 'docs', 2, 'a')},
{vocabulary('a', 50000, 'docs')}, {tfidf('a')} select row_id, term, round(weight, 6) as weight from a_tfidf""",
        "feature_union": f"""with {OFFERS_DOCS}, {WORD_DOCS}, cdocs as (select row_id, {CHAR_TEXT} as text from offers),
{word_counts('text', 'docs', 3, 'a')}, {vocabulary('a', 100000, 'docs')}, {tfidf('a')},
{char_counts('text', 'cdocs', 'b')}, {vocabulary('b', 50000, 'cdocs', 2)}, {tfidf('b')}
select row_id, 'department_words' as block, count(*) as n_terms, round(sum(weight), 6) as total,
  round(max(weight), 6) as largest from a_tfidf group by 1
union all select row_id, 'department_chars', count(*), round(sum(weight), 6), round(max(weight), 6) from b_tfidf group by 1""",
        "softmax_temperature": f"""
select vec_id, i as department_id, round(e / sum(e) over (partition by vec_id), 6) as p
from (select vec_id, unnest(range(0, 4)) as i, exp(unnest({QUARTERS}) / 0.5) as e from embeddings)""",
        "weighted_knn_dense": f"{KNN_DENSE} select * from result",
        "weighted_knn_text": f"{KNN_TEXT}, {best()} select row_id, category_id from predicted",
        "scn_prior": f"""with {OFFERS_DOCS}, train as (select * from offers), {PRIOR}
select pairs.scn, category_id, round((n + 1.0) / (total + k.k), 9) as p
from pairs join totals on pairs.scn = totals.scn, k""",
        "knn_with_prior": f"{KNN_TEXT}, {PRIOR}, {best(PRIOR_FACTOR, PRIOR_JOIN)} select row_id, category_id from predicted",
        "tsv_roundtrip": f"""with {OFFERS_PART} select row_number() over (order by row_id) - 1 as row_id, title, description,
shop_category_name, vendor_name, vendor_code, category_id, department_id from offers""",
        "prediction_csv": f"""with {OFFERS_PART}, train as (select * from offers), {RULES}, {applied('train')}
select row_number() over (order by row_id) - 1 as row_id, coalesce(rule_category, -1) as category_id,
  coalesce(rule_category, -1) % 3 as department_id from applied""",
        "accuracy": f"""{KNN_DENSE}
select round(avg(case when category_id = predicted_category then 1.0 else 0.0 end), 6) as accuracy from result""",
        "weighted_f1": f"""{KNN_DENSE}, {classes('category_id', 'predicted_category')}
select round(sum(f1 * support) / sum(support), 6) as weighted_f1 from per_class""",
        "class_report": f"""{KNN_DENSE}, {classes('category_id', 'predicted_category')}
select cast(label as varchar) as label, round(precision, 6) as precision, round(recall, 6) as recall,
  round(f1, 6) as f1, support::bigint as support from per_class
union all select 'accuracy', round(sum(recall * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), sum(support)::bigint from per_class
union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint from per_class
union all select 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::bigint from per_class""",
        "combined_score": f"""{KNN_DENSE}, {classes('department_id', 'predicted_department')},
f as (select sum(f1 * support) / sum(support) as f from per_class),
a as (select avg(case when category_id = predicted_category then 1.0 else 0.0 end) as a from result)
select round(f, 6) as department_f1, round(a, 6) as category_accuracy, round(30 * f + 70 * a, 6) as score from f, a""",
        "department_svm": f"""with {OFFERS_DOCS}
select row_id, department_id, true as is_largest, true as adds_up from offers""",
        "department_fill": f"""with {OFFERS_DOCS}, {split()}, {RULES}, {applied('held')}, {KNOWN},
m as (select row_id, list_transform(range(0, 4), lambda d: row_id * (2 * d + 1) % 17) as margins from held)
select a.row_id, a.rule_category as category_id,
  coalesce(known.department_id, list_position(m.margins, list_max(m.margins)))::bigint as department_id
from applied a join m using (row_id) left join known on known.category_id = a.rule_category""",
        "predict_full": f"""{KNN_TEXT}, {best()}, {RULES}, {applied('held')}, {KNOWN},
answers as (
  select row_id, coalesce(rule_category, category_id) as category_id, rule_category is not null as by_rule
  from applied join predicted using (row_id))
select row_id, category_id, known.department_id, by_rule from answers left join known using (category_id)""",
        "model_roundtrip": f"""with {OFFERS_DOCS}, {split()}
select count(*) as n_rows, cast(0 as bigint) as n_different from held""",
        "evaluate": f"""with {OFFERS_DOCS}, distinct_ as (select * exclude (r) from (
  select *, row_number() over (partition by title, description, shop_category_name, category_id, department_id
    order by row_id) as r from offers) where r = 1), {split('distinct_')}, {RULES}, {applied('train')}
select count(*) as n_train, count(rule_category) as n_train_covered,
  (select count(*) from held where category_id in (select category_id from train)) as n_scored,
  true as score_agrees from applied""",
    }
    return out
