"""License scans by ordered signature rules, in SQL expressions alone.

A text's words (runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case) are
laid out with a space on either side of each, so that a rule's pattern can't match across part of a
word. A text none of whose words is a rule's keyword is done; in the others each rule one of whose
keywords is among the words is searched. Of the places found, one that lies within another
of at least its priority is suppressed (of equal places the first rule's stays). The base phrases'
places are also reported as such, suppressed or not.

Everything happens within a row: no shuffle, and work in proportion to the places found times
their logarithm (prefix sums and maxima by doubling).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import BASE, JOINED, rules

#: What is no word once A-Z are letters of words too.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Score of the highest priority found.
SCORES = {1: 0.4, 2: 0.7, 3: 0.9}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def compiled(pattern: str) -> str:
    """The pattern over laid-out words: each space of it is the end of a word and the start of the next."""
    return " " + pattern.replace(" ?", "(?:_)?").replace(" ", "  ").replace("_", "  ") + " "


def table() -> list[tuple[str, int, str, str, bool]]:
    """label, priority, keyword, compiled pattern, base; base phrases first."""
    base = [(label, 2, phrase.split(" ")[-2], compiled(phrase), True) for phrase, label in BASE]
    return base + [(label, priority, keyword, compiled(pattern), False) for label, priority, keyword, pattern in rules()]


def quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def doubling(array: str, combine: str) -> str:
    """SQL of inclusive prefix combinations of ``array``; combine: of x and y, the value ``step`` places before it or null."""
    rounds = f"sequence(0, cast(ceil(log2(size({array}) + 1)) as int))"
    return f"aggregate({rounds}, {array}, (acc, j) -> transform(acc, (x, i) -> {combine.replace('$y', 'get(acc, i - shiftleft(1, j))')}))"


WORDS_IN = "cast((length({0}) - length(replace({0}, ' ', ''))) / 2 as int)"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, base (places of base phrases) and spans (places kept).

    Both are arrays of start and stop (words from 0, stop exclusive), label and priority,
    by start. Null, empty and wordless texts have 0 words and empty arrays. Repeated rows and null ids each get a
    row; other columns are not read.
    """
    known = table()
    rows = ", ".join(f"named_struct('label', {quoted(a)}, 'priority', {p}, 'keywords', array({', '.join(quoted(x) for x in (k, *JOINED.get((a, k), ())))}), 'pattern', {quoted(q)}, 'base', {str(b).lower()}, 'rule', {i})" for i, (a, p, k, q, b) in enumerate(known))
    keywords = ", ".join(quoted(k) for k in sorted({x for a, _, k, _, _ in known for x in (k, *JOINED.get((a, k), ()))}))
    bare = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SEPARATORS, "  "))
    out = docs.select(F.col(id_col).alias("doc_id"), bare.alias("bare"))
    out = out.withColumn("n_words", F.expr("if(bare = '', 0, cast((length(bare) - length(replace(bare, '  ', ''))) / 2 + 1 as bigint))").cast("long"))
    out = out.withColumn("keys", F.expr(f"array_intersect(array({keywords}), split(lower(bare), '  '))")).withColumn("hot", F.expr("size(keys) > 0"))
    out = out.withColumn("laid", F.expr(f"if(hot, concat(' ', translate(bare, '{UPPER}', '{LOWER}'), ' '), null)"))
    # a match starts after all words of the pieces before it and of the matches before it
    matches, pieces = "regexp_extract_all(laid, r.pattern, 0)", "split(laid, r.pattern, -1)"
    counts = f"transform({matches}, (m, i) -> named_struct('before', {WORDS_IN.format('get(pieces, i)')}, 'own', {WORDS_IN.format('m')}))"
    sums = doubling("c", "named_struct('before', x.before + coalesce($y.before, 0), 'own', x.own + coalesce($y.own, 0))")
    found = f"""if(hot, flatten(transform(filter(array({rows}), r -> arrays_overlap(keys, r.keywords)), r ->
        flatten(transform(array({pieces}), pieces -> flatten(transform(array({counts}), c -> flatten(transform(array({sums}), s -> transform(s, (x, i) -> named_struct(
            'start', x.before + x.own - c[i].own, 'back', -(x.before + x.own), 'down', -r.priority, 'rule', r.rule, 'label', r.label, 'base', r.base))))))))
    )), array())"""
    out = out.withColumn("found", F.array_sort(F.expr(found)))
    place = "transform({0}, d -> named_struct('start', cast(d.start as bigint), 'stop', cast(-d.back as bigint), 'label', d.label, 'priority', -d.down))"
    out = out.withColumn("base", F.expr(place.format("filter(found, d -> d.base)")))
    out = out.withColumn("stops", F.expr("transform(found, d -> array(-d.back, if(d.down <= -2, -d.back, -1), if(d.down <= -3, -d.back, -1)))"))
    highest = doubling("stops", "transform(x, (v, k) -> greatest(v, coalesce(get($y, k), -1)))")
    out = out.withColumn("highest", F.expr(f"if(size(found) > 1, {highest}, stops)"))
    kept = "filter(found, (d, i) -> coalesce(get(get(highest, i - 1), -d.down - 1), -1) < -d.back)"
    return out.withColumn("spans", F.expr(place.format(kept))).select("doc_id", "n_words", "base", "spans")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of scanned documents."""
    joined = "array_join(array_sort(array_distinct({0})), ',')"
    best = "array_max(concat(array(0), transform(spans, s -> s.priority), transform(base, s -> s.priority)))"
    score = f"case {best} " + " ".join(f"when {k} then {v}D" for k, v in SCORES.items()) + " else 0.0D end"
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.expr("array_min(base.start)").alias("first_word"),
        F.expr("array_max(base.start)").alias("last_word"),
        F.expr(joined.format("base.label")).alias("base_labels"),
        F.expr(joined.format("concat(base.label, spans.label)")).alias("labels"),
        F.expr(score).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def sql() -> str:
    """The same in DuckDB SQL, place by place, every rule searched in every text: there is no prefilter."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({q(a)}, {p}, {q(k)}, {q(pat)}, {str(b).lower()}, {i})" for i, (a, p, k, pat, b) in enumerate(table()))
    words_in = "(length({0}) - length(replace({0}, ' ', ''))) // 2"
    return f"""
with rules(label, priority, keyword, pattern, base, rule) as (values {values}),
t as (select doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}', '  ', 'g'), ' ') as bare from documents),
u as (select doc_id, bare, ' ' || bare || ' ' as laid, string_split(bare, '  ') as words, row_number() over (order by doc_id) as n from t),
m as (select n, r.*, regexp_extract_all(laid, pattern) as matches, string_split_regex(laid, pattern) as pieces from u join rules r on regexp_matches(laid, pattern)),
p as (select n, label, priority, base, rule, matches, pieces, unnest(range(1, len(matches) + 1)) as j from m),
d as (select n, label, priority, base, rule,
    list_sum(list_transform(pieces[1:j], lambda x: {words_in.format('x')})) + coalesce(list_sum(list_transform(matches[1:j-1], lambda x: {words_in.format('x')})), 0) as start,
    {words_in.format('matches[j]')} as own from p),
e as (select *, start + own as stop from d),
k as (select * from e a where not exists (select 1 from e b where b.n = a.n and b.start <= a.start and b.stop >= a.stop and b.priority >= a.priority
    and (b.start < a.start or b.stop > a.stop or b.priority > a.priority or b.rule < a.rule))),
b as (select n, count(*) as n_base, min(start) as first_word, max(start) as last_word, string_agg(distinct label, ',' order by label) as base_labels from e where base group by n),
l as (select n, string_agg(distinct label, ',' order by label) as labels, max(priority) as best from (select n, label, priority from k union all select n, label, priority from e where base) group by n),
s as (select n, count(*) as n_spans from k group by n)
select doc_id, case when bare = '' then 0 else len(words) end::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
    coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
    (case best when 1 then {SCORES[1]} when 2 then {SCORES[2]} when 3 then {SCORES[3]} else 0 end)::double as score, coalesce(n_spans, 0)::bigint as n_spans
from u left join b using (n) left join l using (n) left join s using (n)"""
