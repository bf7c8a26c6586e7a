"""SQL for DuckDB of the queries that SQL can express on whole tables."""

from __future__ import annotations

from wordloom.llm import license_scan as L  # noqa: N812

#: Least vertex that each vertex reaches over links(a, b), both ways; vertices: (v).
_REACH = """reach(v, r) as (select v, v from vertices union select l.b, reach.r from reach join links l on l.a = reach.v),
components as (select v, min(r) as component_id from reach group by v)"""


def ngram_jaccard(n: int = 5, num: int = 80, den: int = 100) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') as ws from documents),
shingles as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < {n} then [array_to_string(ws, ' ')]
 else list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(list_slice(ws, i, i + {n - 1}), ' ')) end) as g from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where {den} * c >= {num} * (x.n + y.n - c)),
vertices as (select doc_id as v from documents), {_REACH}
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from documents d left join sizes s using (doc_id) join components c on c.v = d.doc_id"""


def embedding_near_dedup(threshold: float = 0.95) -> str:
    return f"""with recursive all_vectors as (select vec_id, embedding::double[] as e from embeddings),
sound as (select * from all_vectors where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(e, lambda x: x * x)) > 0),
links as (select a.vec_id as a, b.vec_id as b from sound a join sound b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {threshold}::double),
counts as (select a, count(*) as n from links group by a),
vertices as (select vec_id as v from all_vectors), {_REACH}
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from all_vectors left join counts on a = vec_id join components on v = vec_id"""


def source_divergence(least: int = 30, pseudo: int = 5, top: int = 50) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    p = lambda n, total, kept: f"(1 + (1000000000::hugeint * ({n} + {pseudo})) // ({total} + {pseudo} * {kept}))::bigint"
    return rf"""with docs as materialized (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
 regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
terms as materialized (select id, lang, source, unnest(ts) as term from docs),
counts as materialized (select lang, source, term, count(*) as n from terms group by all),
often as (select lang, term from (select distinct id, lang, term from terms) group by all having count(*) >= {least}),
kept as materialized (select lang, term, sum(n)::bigint as lang_n from counts join often using (lang, term) group by all),
langs as (select lang, count(*) as v, sum(lang_n)::bigint as lang_total from kept group by all),
totals as (select lang, source, sum(n)::bigint as total from counts join kept using (lang, term) group by all),
groups as materialized (select distinct d.lang, d.source, coalesce(total, 0) as total, coalesce(v, 0) as v, lang_total from docs d left join totals using (lang, source) left join langs using (lang)),
shares as materialized (select g.lang, g.source, term, coalesce(n, 0) as n, {p("coalesce(n, 0)", "total", "v")} as p, {p("lang_n", "lang_total", "v")} as q
 from groups g join kept using (lang) left join counts using (lang, source, term)),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as s from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
found as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source
 union all select lang, source, 'term', term, p - q from shares where n > 0 and p > q)
select * from (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from found) where part = 'pair' or rank <= {top}"""


def license_scan() -> str:
    """The same templates; their rare words are counted, and their places looked up, in SQL."""
    quote = lambda w: "'" + w.replace("'", "''") + "'"
    own = list(enumerate(L.PHRASES + L.NOTICES))
    templates = ", ".join(f"({k}, {quote(t.label)}, {L.rare_count(t)}, {L.least_count(t)}, {len(t.words)}, {'true' if t.keys else 'false'})" for k, t in own)
    words = ", ".join(f"({k}, {quote(w)}, {q})" for k, t in own for w, q in L.candidates(t).items())
    phrase = lambda ws: "[" + ", ".join(map(quote, ws)) + "]"
    keys = ", ".join(f"({k}, {n}, {phrase(L.words_of(key))})" for k, t in own for n, key in enumerate(t.keys or (t.text,)))
    return rf"""with docs as materialized (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{L.UPPER}', '{L.LOWER}'), '{L.WORD}') as ws from documents),
templates(k, label, rare, need, size, notice) as (values {templates}), words(k, w, q) as (values {words}), keys(k, n, phrase) as (values {keys}),
tokens as materialized (select row, unnest(ws) as w, unnest(range(len(ws))) as p from docs where len(ws) > 0),
known as materialized (select tokens.* from tokens where w in (select w from words)),
df as (select w, count(distinct row) as df from known group by w),
postings as materialized (select k, w, q from (select *, row_number() over (partition by k order by coalesce(df, 0), w) as r from words left join df using (w)) join templates using (k) where r <= rare),
pointers as materialized (select distinct row, k, p - q as o, q from known join postings using (w)),
places as (select a.row, a.k, a.o, count(distinct b.q) as n from (select distinct row, k, o from pointers) a join pointers b on a.row = b.row and a.k = b.k and b.o between a.o and a.o + {L.SLACK} group by all),
enough as materialized (select row, k, o, n, rare, size, notice, label, case when notice then greatest(o - {L.SLACK}, 0) else o end as low from places join templates using (k) where n >= need),
spans as (select e.*, keys.n as key, phrase, case when notice then list_slice(ws, low + 1, o + size + {2 * L.SLACK}) else case when o >= 0 then list_slice(ws, o + 1, o + size) else [] end end as part from enough e join docs using (row) join keys using (k)),
kept as (select row, k, o, label, notice, n / rare as share from spans group by all having bool_and(len(list_filter(range(len(part)), lambda i: list_slice(part, i + 1, i + len(phrase)) = phrase)) > 0)),
sums as (select row, count(*) filter (not notice) as n_base, min(o) filter (not notice) as first_word, max(o) filter (not notice) as last_word,
 string_agg(distinct label, ',' order by label) filter (not notice) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share)::double as score from kept group by row)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0) as score
from docs left join sums using (row)"""


ORACLES = {"op3_ngram_jaccard_join": ngram_jaccard(), "op10_embedding_near_dedup": embedding_near_dedup(), "op11_license_scan": license_scan(), "op12_source_divergence": source_divergence()}
