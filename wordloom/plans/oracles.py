"""The registered queries in DuckDB's SQL, put together from shared table expressions."""

from __future__ import annotations

from wordloom.functions import cleaning as K  # noqa: N812
from wordloom.functions import lexicon
from wordloom.sources import html


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return ", ".join(map(_q, words))


_FORM = "lower(translate({}, '’‘‐‑–—', '''''----'))"
_PLAIN_WORD = r"[\p{L}\p{M}]+(?:['’‘\-‐‑–—][\p{L}\p{M}]+)*"
_WORD = _q(_PLAIN_WORD)
_GAP_WORD = _q(rf"([^\p{{L}}\p{{M}}]*)({_PLAIN_WORD})")
_TRIM = r"regexp_replace({}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"


def form(c: str) -> str:
    return _FORM.format(c)


def trim(c: str) -> str:
    return _TRIM.format(c)


def stop(word: str, run: str = "run") -> str:
    return "(" + " or ".join(f"({run} = {_q(k)} and {word} in ({_list(v)}))" for k, v in lexicon.STOP_WORDS.items()) + ")"


DOCS = "chapters as (select lang as run, source as book, doc_id as chapter_id, text from documents)"
TALK = "chapters as (select role as run, conv_id::varchar as book, conv_id * 1000 + turn as chapter_id, text from conversations)"
LABELLED = "chapters as (select case when quality = 1 then 'good' else 'poor' end as run, source as book, d.doc_id as chapter_id, text from documents d join labels l on d.doc_id = l.doc_id where quality is not null)"

#: A book that is added to a saved run, and those (run, book) that are taken from it.
ADDED, REMOVED = "src1", (("en", "src2"), ("de", "src0"))
LEFT = f"chapters as (select lang as run, source as book, doc_id as chapter_id, text from documents where not ({' or '.join(f'lang = {_q(a)} and source = {_q(b)}' for a, b in REMOVED)}))"

#: Books whose index is damaged, the words that one loses, and what is added to ids of chapters that aren't there.
FAULTS = {"missing": "src3", "lost": "src7", "twice": "src5", "unknown": "src9"}
LOST_WORDS, FAR = ("the", "that", "de", "la", "und"), 10**12

#: t: a row for each word of each chapter; totals: words of each run.
TOKENS = f"""
arrays as (select run, book, chapter_id, regexp_extract_all(text, {_GAP_WORD}, 2) as raws, regexp_extract_all(text, {_GAP_WORD}, 1) as gaps from chapters),
raw_t as (select run, book, chapter_id, unnest(generate_series(1, len(raws)))::bigint as pos, unnest(raws) as raw, unnest(gaps) as gap from arrays),
t as materialized (select *, {form('raw')} as word from raw_t),
totals as (select run, count(*) as total from t group by run)"""

FOR_READING = trim(
    r"regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(text, '\r\n?', chr(10), 'g'), '’‘“”—–', '''''\"\"--'), '[\t\f\x0B\x{00A0}]+', ' ', 'g'), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')".replace(r"\"", '"')
)


def _protected(c: str) -> str:
    """Full stops that end no sentence, as chr(1)."""
    one = "chr(1)"
    for _ in range(2):
        c = rf"regexp_replace({c}, '(\p{{Nd}})\.(\p{{Nd}})', '\1' || {one} || '\2', 'g')"
    c = rf"regexp_replace({c}, '\.\.', {one} || '.', 'g')"
    c = rf"regexp_replace({c}, '\.\x01', {one} || {one}, 'g')"
    for _ in range(2):
        c = rf"regexp_replace({c}, '(^|[^\p{{L}}.\x01])((?i:mr|mrs|ms|dr|prof|sr|jr|st|vs|etc))\.([^\p{{L}}.\x01]|$)', '\1\2' || {one} || '\3', 'g')"
        c = rf"regexp_replace({c}, '(^|[^\p{{L}}.\x01])((?i:e))\.((?i:g))\.([^\p{{L}}.\x01]|$)', '\1\2' || {one} || '\3' || {one} || '\4', 'g')"
        c = rf"regexp_replace({c}, '(^|[^\p{{L}}.\x01])((?i:i))\.((?i:e))\.([^\p{{L}}.\x01]|$)', '\1\2' || {one} || '\3' || {one} || '\4', 'g')"
        c = rf"regexp_replace({c}, '(^|[^\p{{L}}.\x01])((?i:u))\.((?i:s|k))\.([^\p{{L}}.\x01]|$)', '\1\2' || {one} || '\3' || {one} || '\4', 'g')"
    return c


_CL = r"""["'”’»)\]}]"""
_SENTENCE = _q(rf"(?s)[^.?!]*[.?!](?:{_CL}+(?:[\s\pZ,;]*\p{{Ll}}[^.?!]*[.?!]{_CL}*)?)?|.+")
#: s: a row for each sentence of each chapter.
SENTENCES = f"""
plain as (select run, book, chapter_id, {FOR_READING} as n from chapters),
guarded as (select run, book, chapter_id, {_protected('n')} as n from plain),
lists as (select run, book, chapter_id, list_filter(list_transform(regexp_extract_all(n, {_SENTENCE}), lambda x: {trim("replace(x, chr(1), '.')")}), lambda x: x <> '') as ss from guarded),
s as (select run, book, chapter_id, unnest(generate_series(0, len(ss) - 1))::bigint as sentence_index, unnest(ss) as sentence from lists where len(ss) > 0),
sw as (select *, list_transform(regexp_extract_all(sentence, {_WORD}), lambda x: {form('x')}) as ws from s)"""

WORDS = f"""
words as (select t.run, word, count(*) as count, count(distinct chapter_id) as document_count, count(*) * 1000000.0::double / any_value(total) as frequency_per_million, {stop('word', 't.run')} as is_stop_word
from t join totals using (run) group by t.run, word)"""


def _with(*parts: str, select: str, chapters: str = DOCS) -> str:
    return "with " + ",\n".join([chapters, *parts]) + "\n" + select


def word_frequencies(chapters: str = DOCS) -> str:
    return _with(TOKENS, WORDS, select="select * from words", chapters=chapters)


def top_words(n: int, where: str = "true") -> str:
    return _with(TOKENS, WORDS, select=f"select * from (select *, row_number() over (partition by run order by count desc, word) as rank from words where {where}) where rank <= {n}")


def word_detail(word: str) -> str:
    return _with(TOKENS, WORDS, select=f"select * from words where word = {_q(word)}")


def token_index() -> str:
    return _with(TOKENS, select=f"""select run, book, chapter_id, pos as chapter_position, raw as token_text, word, (e - length(raw))::bigint as start_offset, e as end_offset, {stop('word')} as is_stop_word
from (select *, (sum(length(gap) + length(raw)) over (partition by chapter_id order by pos))::bigint as e from t)""")


def run_positions() -> str:
    return _with(TOKENS, select="""select run, book, chapter_id, tokens, (coalesce(before, 0) + 1)::bigint as first_run_position, (coalesce(before, 0) + tokens)::bigint as last_run_position
from (select *, sum(tokens) over (partition by run order by book, chapter_id rows between unbounded preceding and 1 preceding) as before
from (select run, book, chapter_id, count(*) as tokens from t group by all))""")


def index_summary() -> str:
    return _with(TOKENS, select=f"""select run, count(*) as token_count, count(distinct word) as distinct_token_count, count(*) filter ({stop('word')}) as stop_word_token_count,
count(*) filter (not {stop('word')}) as content_token_count, count(distinct chapter_id) as chapter_count from t group by run""")


DIAGNOSTICS = """
want as (select run, sum(len(ws))::bigint as expected_word_token_count from sw group by run),
have as (select run, count(*) as n, count(distinct chapter_id) as c, count(distinct book) as b from t group by run),
alls as (select run, count(*) as expected_chapter_count, count(distinct book) as source_book_count from chapters group by run),
diag as (select run, expected_word_token_count, expected_chapter_count, source_book_count, n as indexed_word_token_count, c as indexed_chapter_count, b as indexed_book_count,
1::bigint as first_run_position, n as last_run_position, 0::bigint as run_position_gap_count, (n - expected_word_token_count)::bigint as word_token_delta, n * 100.0::double / expected_word_token_count as coverage_percentage
from alls join want using (run) join have using (run))"""


def index_diagnostics() -> str:
    return _with(TOKENS, SENTENCES, DIAGNOSTICS, select="select * from diag")


def health() -> str:
    return _with(TOKENS, SENTENCES, DIAGNOSTICS, select="""select run, concat_ws('; ', case when word_token_delta <> 0 then 'token index delta is ' || printf('%+d', word_token_delta) end,
case when indexed_chapter_count <> expected_chapter_count then 'indexed chapters are ' || indexed_chapter_count || ' of ' || expected_chapter_count end,
case when indexed_book_count <> source_book_count then 'indexed source books are ' || indexed_book_count || ' of ' || source_book_count end) as warnings,
word_token_delta = 0 and indexed_chapter_count = expected_chapter_count and indexed_book_count = source_book_count as overall_ok from diag""")


def collocations(word: str, window: int, where: str = "true") -> str:
    return _with(TOKENS, select=f"""
, cc as (select run, word, count(*) as n from t group by all),
near as (select run, book, chapter_id, pos + o as pos, o from (select run, book, chapter_id, pos, unnest(range(-{window}, {window} + 1)) as o from t where word = {_q(word)}) where o <> 0),
pairs as (select a.run, b.word as collocate, a.o from near a join t b on a.chapter_id = b.chapter_id and a.run = b.run and a.book = b.book and a.pos = b.pos where b.word <> {_q(word)}),
found as (select run, collocate, count(*) as count, count(*) filter (o < 0) as left_count, count(*) filter (o > 0) as right_count, sum(abs(o))::bigint as distance from pairs group by all),
done as (select f.run, {_q(word)} as word, collocate, f.count, left_count, right_count, f.count::double / g.n as rate_per_target, distance::double / f.count as average_distance,
2.0::double * least(f.count, g.n, c.n) / (g.n + c.n) as dice from found f join cc c on f.run = c.run and f.collocate = c.word join cc g on g.run = f.run and g.word = {_q(word)})
select * from done where {where}""")


def concordance(word: str, k: int) -> str:
    spaces = r"'[\s\pZ]+'"
    left, right = r"""[\s\pZ,;:.!?…"'”’»)\]}]+$""", r"""^[\s\pZ,;:.!?…"'“‘«(\[{]+"""
    snippet = lambda c, edge: f"regexp_replace({trim(f'regexp_replace({c}, {spaces}, chr(32), chr(103))')}, {_q(edge)}, '')"
    return _with(TOKENS, select=f"""
, ends as (select *, (sum(length(gap) + length(raw)) over (partition by chapter_id order by pos))::bigint as e from t),
around as (select *, e - length(raw) as b, first_value(e - length(raw)) over (partition by chapter_id order by pos rows between {k} preceding and current row) as first_left,
last_value(e) over (partition by chapter_id order by pos rows between current row and {k} following) as last_right from ends),
hits as (select *, row_number() over (partition by chapter_id order by pos) as occurrence_index from around where word = {_q(word)})
select h.run, h.book, h.chapter_id, occurrence_index, pos as chapter_position, raw as token_text,
{snippet('substr(c.text, (first_left + 1)::bigint, (b - first_left)::bigint)', left)} as left_context, {snippet('substr(c.text, (e + 1)::bigint, (last_right - e)::bigint)', right)} as right_context, b::bigint as start_offset
from hits h join chapters c using (chapter_id)""".replace("chr(32)", "' '").replace("chr(103)", "'g'"))


_FIRST, _LAST = "split_part(phrase, ' ', 1)", "split_part(phrase, ' ', -1)"
PHRASES = r"""
cut as (select *, sum(case when pos > 1 and not regexp_full_match(gap, '[\s\pZ]*') then 1 else 0 end) over (partition by chapter_id order by pos) as seg from t),
segs as (select run, chapter_id, list(word order by pos) as ws from cut group by run, chapter_id, seg),
spans as (select run, chapter_id, ws, unnest(range({low}, {high} + 1)) as n from segs),
starts as (select run, chapter_id, n, ws, unnest(range(1, len(ws) - n + 2)) as i from spans where len(ws) >= n),
grams as (select run, chapter_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') as phrase from starts),
phrases as (select g.run, n::bigint as n, phrase, count(*) as count, count(distinct chapter_id) as chapter_count, count(*) * 1000000.0::double / any_value(total) as frequency_per_million
from grams g join totals using (run) group by g.run, n, phrase having count(*) >= {least})"""


def phrases(low: int, high: int, least: int, how: str = "") -> str:
    parts = (TOKENS, PHRASES.format(low=low, high=high, least=least))
    if how == "boundary":
        kind = lambda w: f"case when {stop(w)} then 'function' else 'content' end"
        return _with(*parts, select=f"select *, {kind('''split_part(phrase, ' ', 1)''')} || '/' || {kind('''split_part(phrase, ' ', -1)''')} as boundary from phrases")
    if how == "content":
        return _with(*parts, select=f"select * from phrases where not {stop(_FIRST)} and not {stop(_LAST)}")
    if how == "longest":
        return _with(*parts, select="""select p.* from phrases p where not exists (select 1 from phrases q where q.run = p.run and q.count = p.count and q.chapter_count = p.chapter_count and q.n > p.n and contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))""")
    return _with(*parts, select="select * from phrases")


def ranked(sql: str, order: str, n: int, by: str = "partition by run") -> str:
    """The first n rows of a query's groups, with their rank."""
    return f"select * from (select *, row_number() over ({by} order by {order}) as rank from ({sql})) where rank <= {n}"


def sentences() -> str:
    return _with(SENTENCES, select="select run, chapter_id, sentence_index, sentence from s")


_TOKEN = _q(rf"{_PLAIN_WORD}|\p{{N}}+(?:[.,]\p{{N}}+)*|\p{{P}}|\p{{S}}|[^\s\pZ]")
_KIND = r"case when regexp_matches({0}, '^[\p{{L}}\p{{M}}]') then 'Word' when regexp_matches({0}, '^\p{{N}}') then 'Number' when regexp_matches({0}, '^\p{{P}}') then 'Punctuation' when regexp_matches({0}, '^\p{{S}}') then 'Symbol' else 'Other' end"


def sentence_tokens() -> str:
    return _with(SENTENCES, select=f"""
, lists2 as (select run, chapter_id, sentence_index, regexp_extract_all(sentence, {_TOKEN}) as ts from s),
k as (select run, chapter_id, sentence_index, unnest(generate_series(0, len(ts) - 1))::bigint as token_index, unnest(ts) as token_text from lists2 where len(ts) > 0)
select *, {_KIND.format('token_text')} as kind, case when {_KIND.format('token_text')} = 'Word' then {form('token_text')} else translate(token_text, '’‘‐‑–—', '''''----') end as normalized from k""")


def sentence_lengths() -> str:
    return _with(SENTENCES, select=f"select run, chapter_id, sentence_index, sentence, len(list_filter(regexp_extract_all(sentence, {_TOKEN}), lambda x: not regexp_matches(x, '^\\p{{P}}')))::bigint as token_count from s")


SUMMARY = f"""
docs as (select run, count(*) as document_count from chapters group by run),
sizes as (select run, count(*) as sentence_count, sum(len(regexp_extract_all(sentence, {_TOKEN})))::bigint as token_count from s group by run),
wc as (select run, count(*) as word_token_count, count(distinct word) as distinct_word_count, sum(length(word))::bigint as chars from t group by run),
summary as (select run, document_count, sentence_count, token_count, word_token_count, distinct_word_count, word_token_count::double / sentence_count as average_words_per_sentence,
chars::double / word_token_count as average_characters_per_word from docs join sizes using (run) join wc using (run))"""


def corpus_summary() -> str:
    return _with(TOKENS, SENTENCES, SUMMARY, select="select * from summary")


NGRAMS = """
spans as (select run, chapter_id, ws, unnest(range({low}, {high} + 1)) as n from sw),
starts as (select run, chapter_id, n, ws, unnest(range(1, len(ws) - n + 2)) as i from spans where len(ws) >= n),
grams as (select run, chapter_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') as text from starts),
ngrams as (select g.run, n::bigint as n, g.text, count(*) as count, count(distinct chapter_id) as document_count, count(*) * 1000000.0::double / any_value(total) as frequency_per_million
from grams g join totals using (run) group by g.run, n, g.text having count(*) >= {least})"""


def ngrams(low: int, high: int, least: int, where: str = "true") -> str:
    return _with(TOKENS, SENTENCES, NGRAMS.format(low=low, high=high, least=least), select=f"select * from ngrams where {where}")


def ngram_patterns(low: int, high: int, least: int, where: str = "true") -> str:
    letter = f"case when {stop('x')} then 'F' else 'C' end"
    return _with(TOKENS, SENTENCES, NGRAMS.format(low=low, high=high, least=least), select=f"select * from (select *, array_to_string(list_transform(string_split(text, ' '), lambda x: {letter}), '-') as pattern from ngrams) where {where}")


NEXT = """
nexts as (select run, unnest(list_slice(ws, 1, len(ws) - 1)) as word, unnest(list_slice(ws, 2, len(ws))) as next_word from sw where len(ws) > 1),
tops as (select run, word from (select run, word, row_number() over (partition by run order by count(*) desc, word) as r from t group by run, word) where r <= {top}),
pairs as (select run, word, next_word, count(*) as count from nexts semi join tops using (run, word) group by all),
next_words as (select run, word, next_word, count, count::double / total as probability from (select *, (sum(count) over (partition by run, word))::bigint as total from pairs) where count >= {least})"""


def next_words(top: int, least: int, where: str = "true") -> str:
    return _with(TOKENS, SENTENCES, NEXT.format(top=top, least=least), select=f"select * from next_words where {where}")


def sentence_categories(chapters: str = DOCS) -> str:
    closers = r"""["'”’»)\]}]"""
    end = f"regexp_extract({trim('sentence')}, {_q(rf'(?s)([?!]){closers}*$')}, 1)"
    quoted = "regexp_extract(sentence, " + _q(r"""(?s)^[\s\pZ]*["'“‘«][^?!]*([?!][^"'”’»]*)["'”’»]""") + ", 1)"
    mark = f"case when {end} <> '' then {end} else regexp_extract({quoted}, '(?s)([?!])[^?!]*$', 1) end"
    return _with(SENTENCES, chapters=chapters, select=f"""
, c as (select run, case when {mark} = '?' then 'Question' when {mark} = '!' then 'Exclamation'
when len(ws) > 0 and (ws[1] in ({_list(lexicon.GREETINGS)}) or array_to_string(list_slice(ws, 1, 2), ' ') in ({_list(lexicon.GREETINGS)})) then 'Greeting'
when list_has_any(ws, [{_list(lexicon.NEGATIONS)}]) then 'Negation' when list_has_any(ws, [{_list(lexicon.REQUEST_MARKERS)}]) then 'Request'
when len(ws) > 0 then 'Statement' else 'Other' end as category from sw)
select run, category, count(*) as count, count(*) * 100.0::double / any_value(total) as percentage from c join (select run, count(*) as total from c group by run) using (run) group by run, category""")


def compare_words(left: str, right: str, least: int, where: str = "true", chapters: str = DOCS) -> str:
    return _with(TOKENS, WORDS, chapters=chapters, select=f"""
, l as (select * from words where run = {_q(left)}), r as (select * from words where run = {_q(right)}),
j as (select coalesce(l.word, r.word) as word, coalesce(l.count, 0) as left_count, coalesce(l.document_count, 0) as left_document_count, coalesce(l.frequency_per_million, 0) as left_per_million,
coalesce(r.count, 0) as right_count, coalesce(r.document_count, 0) as right_document_count, coalesce(r.frequency_per_million, 0) as right_per_million,
coalesce(l.is_stop_word, false) or coalesce(r.is_stop_word, false) as is_function_word from l full join r on l.word = r.word)
select *, left_count + right_count as total_count, left_count::double / (left_count + right_count) as left_share, right_count::double / (left_count + right_count) as right_share,
left_per_million - right_per_million as difference_per_million, abs(left_per_million - right_per_million) as absolute_difference_per_million,
case when right_per_million = 0 then (case when left_per_million = 0 then 0.0::double else 'inf'::double end) else left_per_million / right_per_million end as ratio,
case when abs(left_per_million - right_per_million) < 0.000001::double then 'tie' when left_per_million > right_per_million then 'left' else 'right' end as direction
from j where (left_count >= {least} or right_count >= {least}) and {where}""")


def _difficulty() -> str:
    long = "case run " + " ".join(f"when {_q(p[0])} then {p[3]}" for p in lexicon.PROFILES) + f" else {lexicon.UNKNOWN_THRESHOLDS[0]} end"
    very = "case run " + " ".join(f"when {_q(p[0])} then {p[4]}" for p in lexicon.PROFILES) + f" else {lexicon.UNKNOWN_THRESHOLDS[1]} end"
    return f"""
sums as (select run, (sum(count) filter (not is_stop_word))::bigint as content_tokens, coalesce(sum(count) filter (is_stop_word), 0)::bigint as function_tokens,
coalesce(sum(count) filter (length(word) >= {long}), 0)::bigint as long_tokens, coalesce(sum(count) filter (length(word) >= {very}), 0)::bigint as very_long_tokens from words group by run),
shares as (select *, content_tokens / word_token_count::double as content_share, function_tokens / word_token_count::double as function_share, long_tokens / word_token_count::double as long_share,
very_long_tokens / word_token_count::double as very_long_share, distinct_word_count * 1000.0::double / word_token_count as lexical_diversity from summary join sums using (run)),
profiles as (select run, word_token_count, distinct_word_count, content_tokens, function_tokens, long_tokens, very_long_tokens, content_share, function_share, long_share, very_long_share, lexical_diversity,
average_words_per_sentence * 2.0::double + average_characters_per_word * 8.0::double + long_share * 100.0::double * 0.6::double + very_long_share * 100.0::double * 0.8::double + content_share * 100.0::double * 0.2::double + lexical_diversity * 0.08::double as score from shares)"""


def difficulty() -> str:
    return _with(TOKENS, WORDS, SENTENCES, SUMMARY, _difficulty(), select="select * from profiles")


def compare_difficulty(left: str, right: str) -> str:
    cols = lambda s: f"{s}.run as {s}_run, {s}.score as {s}_score, {s}.lexical_diversity as {s}_diversity, {s}.long_share as {s}_long_share"
    return _with(TOKENS, WORDS, SENTENCES, SUMMARY, _difficulty(), select=f"""
select {cols('"left"').replace('"left"_', 'left_')}, {cols('"right"').replace('"right"_', 'right_')}, "right".score - "left".score as score_difference,
case when abs("right".score - "left".score) < 0.000001 then 'tie' when "right".score > "left".score then "right".run else "left".run end as harder
from profiles "left", profiles "right" where "left".run = {_q(left)} and "right".run = {_q(right)}""")


def language_profiles() -> str:
    rows = ", ".join("(" + ", ".join(_q(x) if isinstance(x, str) else f"{x}::bigint" for x in p) + f", {len(lexicon.STOP_WORDS[p[0]])}::bigint)" for p in lexicon.PROFILES)
    counts = f"select run as code, count(distinct chapter_id) as document_count, count(*) filter ({stop('word')}) as stop_word_token_count from t group by run"
    return _with(TOKENS, select=f"""select v.*, coalesce(document_count, 0) as document_count, coalesce(stop_word_token_count, 0) as stop_word_token_count
from (values {rows}) v(code, name, family, long_word_length, very_long_word_length, apostrophes, stop_word_count) left join ({counts}) using (code)""")


def normalize_text() -> str:
    one_line = trim(r"regexp_replace(replace(reading, chr(10), ' '), ' {2,}', ' ', 'g')")
    return f"select chapter_id, reading, {one_line} as one_line, lower({one_line}) as key from (select doc_id as chapter_id, {FOR_READING} as reading from documents)"


def run_books() -> str:
    return _with(select="select run, book, count(*) as chapter_count, coalesce(sum(length(text)), 0)::bigint as character_count from chapters group by run, book")


def word_distribution(word: str) -> str:
    return _with(TOKENS, select=f"""
, b as (select run, book, count(*) as chapter_count, sum(length(text))::bigint as character_count from chapters group by run, book),
c as (select run, book, count(*) as word_token_count, count(*) filter (word = {_q(word)}) as count from t group by run, book)
select run, book, chapter_count, character_count, word_token_count, count, count * 1000000.0::double / word_token_count as frequency_per_million from b join c using (run, book) where count > 0""")


def word_coverage(word: str) -> str:
    return _with(TOKENS, select=f"""
, c as (select run, book, bool_or(word = {_q(word)}) as has from t group by run, book)
select run, count(*) filter (has) as matched_books, count(*) as source_books, count(*) filter (has) * 100.0::double / count(*) as coverage_percentage from c group by run""")


def _any(c: str, terms) -> str:
    return "(" + " or ".join(f"contains({c}, {_q(t)})" for t in terms) + ")"


def chapter_metrics() -> str:
    return _with(SENTENCES, select=f"""
, z as (select chapter_id, count(*) as sentence_count, sum(len(ws))::bigint as word_count from sw group by chapter_id),
f as (select *, length(text) as character_count, not regexp_matches(text, '[^\\s\\pZ]') as is_empty, {_any('lower(text)', lexicon.TEXT_MARKERS)} as odd from chapters)
select run, book, chapter_id, character_count, coalesce(word_count, 0) as word_count, coalesce(sentence_count, 0) as sentence_count,
coalesce(nullif(concat_ws(' · ', case when is_empty then 'empty' when character_count < 200 then 'very short' end, case when character_count >= 100000 then 'very long' end, case when odd then 'potentially suspicious' end), ''), 'normal') as quality
from f left join z using (chapter_id)""")


def find_in_chapters(term: str) -> str:
    return _with(select=f"select run, book, chapter_id, matches from (select *, len(regexp_extract_all(text, {_q('(?i)' + term)}))::bigint as matches from chapters) where matches > 0")


def find_positions(term: str) -> str:
    return _with(select=f"""
, p as (select run, book, chapter_id, text, regexp_extract_all(text, {_q('(?i)' + term)}) as ms, regexp_split_to_array(text, {_q('(?i)' + term)}) as parts from chapters),
u as (select run, book, chapter_id, unnest(range(1, len(ms) + 1)) as match_index, unnest(ms) as match, unnest(list_slice(parts, 1, len(ms))) as gap from p where len(ms) > 0)
select run, book, chapter_id, match_index, match, (sum(length(gap) + length(match)) over (partition by run, book, chapter_id order by match_index) - length(match))::bigint as start_offset from u""")


def word_explorer(word: str, related: int, contexts: int, k: int, books: int) -> str:
    nexts = next_words(1000, 2)
    one = lambda section, sql, order, n, item, count, value: f"select run, '{section}' as section, rank, {item} as item, {count} as count, {value}::double as value from ({ranked(sql, order, n)})"
    return " union all ".join((
        one("word", word_detail(word), "word", 1, "word", "count", "frequency_per_million"),
        one("next", f"select * from ({nexts}) where word = {_q(word)}", "count desc, next_word", related, "next_word", "count", "probability"),
        one("previous", f"select * from ({nexts}) where next_word = {_q(word)}", "count desc, word", related, "word", "count", "probability"),
        one("context", concordance(word, k), "book, chapter_id, occurrence_index", contexts, "concat_ws(' | ', left_context, token_text, right_context)", "chapter_position", "null"),
        one("book", word_distribution(word), "count desc, book", books, "book", "count", "frequency_per_million"),
    ))


def _suspicion() -> str:
    lines = "list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: " + trim("x") + "), lambda x: x <> ''), 1, 60)"
    contents = rf"(len(list_filter({lines}, lambda x: lower(x) in ('contents', 'indice', 'sommario'))) > 0 or len(list_filter({lines}, lambda x: regexp_matches(x, '(?i)^(chapter|capitolo)\s+([ivxlcdm]+|[0-9]+)'))) >= 5)"
    strong = " ".join(f"when contains(lower(text), {_q(t)}) then {_q(f"contains '{t}'")}" for t in lexicon.STRONG_TERMS)
    weak = "case " + " ".join(f"when contains(lower(text), {_q(t)}) then {_q(f"contains possible front matter term '{t}'")}" for t in lexicon.WEAK_TERMS) + " end"
    near = _any("lower(substr(text, 1, 1500))", lexicon.WEAK_TERMS)
    return f"case when length(text) = 0 then 'empty chapter' when length(text) < 500 and {contents} then 'short table-of-contents-like chapter' {strong} when {_any('lower(text)', lexicon.WEAK_TERMS)} and ({contents} or (length(text) < 5000 and {near})) then {weak} end"


def suspicious_chapters() -> str:
    return _with(select=f"select * from (select run, book, chapter_id, length(text) as character_count, {_suspicion()} as reason from chapters) where reason is not null")


def import_diagnostics() -> str:
    return _with(select=f"""select run, count(distinct book) as book_count, count(*) as chapter_count, sum(length(text))::bigint as total_characters, sum(length(text))::double / count(*) as average_characters,
count(*) filter (length(text) = 0) as empty_chapters, count(*) filter (length(text) > 0 and length(text) < 500) as short_chapters, count(*) filter (length(text) > 50000) as long_chapters,
count(*) filter (({_suspicion()}) is not null) as suspicious_chapters from chapters group by run""")


def suspicious_terms() -> str:
    one = lambda t: f"select {_q(t)} as term, sum((length(lower(text)) - length(replace(lower(text), {_q(t)}, ''))) // {len(t)})::bigint as count from documents"
    return "select * from (" + " union all ".join(map(one, lexicon.SUSPICIOUS_TERMS)) + ") where count > 0"


def extreme_chapters(order: str, n: int) -> str:
    one_line = trim(r"regexp_replace(replace(reading, chr(10), ' '), ' {2,}', ' ', 'g')")
    return _with(select=f"select run, book, chapter_id, length(text) as character_count, substr({one_line}, 1, 80) as preview from (select *, {FOR_READING} as reading from chapters) order by character_count {order}, run, book, chapter_id limit {n}")


def corpus_profile(n: int, low: int, high: int, least: int, chapters_least: int) -> str:
    own = f"not {stop(_FIRST, 'p.run')} and not {stop(_LAST, 'p.run')} and chapter_count >= {chapters_least}"
    return _with(TOKENS, WORDS, SENTENCES, SUMMARY, _difficulty(), PHRASES.format(low=low, high=high, least=least), select=f"""
, ranked as (select run, word, row_number() over (partition by run, is_stop_word order by count desc, word) as r, is_stop_word from words),
b as (select run, count(distinct book) as book_count from chapters group by run),
chosen as (select * from phrases p where {own}),
longest as (select * from chosen p where not exists (select 1 from chosen q where q.run = p.run and q.count = p.count and q.chapter_count = p.chapter_count and q.n > p.n and contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))),
tops as (select run, string_agg(phrase, '; ' order by r) as top_phrases from (select *, row_number() over (partition by run order by count desc, n desc, phrase) as r from longest) where r <= {n} group by run)
select s.*, book_count, content_share, function_share, long_share, very_long_share, lexical_diversity, score as difficulty_score,
coalesce((select string_agg(word, ' ' order by r) from ranked k where k.run = s.run and r <= {n} and not is_stop_word), '') as top_content_words,
coalesce((select string_agg(word, ' ' order by r) from ranked k where k.run = s.run and r <= {n} and is_stop_word), '') as top_function_words,
coalesce(top_phrases, '') as top_phrases from summary s join b using (run) join (select run, content_share, function_share, long_share, very_long_share, lexical_diversity, score from profiles) using (run) left join tops using (run)""")


def source_books() -> str:
    return """with runs as (select distinct lang as run_id, min(source) over (partition by lang) as book_id from documents),
links as (select distinct lang as run_id, source as book_id, 2 as order_index from documents where lang <> 'es')
select * from links union all select run_id, book_id, 1 from runs where not exists (select 1 from links l where l.run_id = runs.run_id)"""


def language_note() -> str:
    return "select string_agg(code, ', ' order by code) as languages, count(*) > 1 as different_languages from (select distinct lower(lang) as code from documents where lang in ('en', 'de'))"


#: Marker lines around a text, for the query that removes them.
MARKED = ("Header\n*** START OF THE PROJECT GUTENBERG EBOOK SAMPLE ***\n\n", "\n*** END OF THE PROJECT GUTENBERG EBOOK SAMPLE ***\nLicence")


def boilerplate_markers() -> str:
    marked = " || ".join((_q(MARKED[0]), "text", _q(MARKED[1])))
    body = rf"regexp_replace({marked}, '(?i)(?m:^)\s*\*{{3}}\s*END OF (?:THE )?PROJECT GUTENBERG EBOOK(?s:.*)', '')"
    return rf"select doc_id as chapter_id, regexp_replace({body}, '(?i)^(?s:.*?)\n\s*\*{{3}}\s*START OF (?:THE )?PROJECT GUTENBERG EBOOK.*?\*{{3}}\s*', '') as text from documents"


def stored_chapters() -> str:
    return _with(SENTENCES, select="""select c.run, c.book, c.chapter_id, length(text)::bigint as character_count, coalesce(n, 0)::bigint as word_count, coalesce(k, 0)::bigint as sentence_count
from chapters c left join (select run, book, chapter_id, sum(len(ws)) as n, count(*) as k from sw group by all) using (run, book, chapter_id)""")


def index_faults() -> str:
    words = _list(LOST_WORDS)
    book = {k: _q(v) for k, v in FAULTS.items()}
    return _with(TOKENS, SENTENCES, select=f"""select * from (with p as materialized (select run, book, chapter_id, pos, word from t),
sizes as (select run, book, chapter_id, sum(len(ws))::bigint as n from sw group by all having sum(len(ws)) > 0),
have as materialized (select * from p where book <> {book['missing']} and not (book = {book['lost']} and word in ({words})) union all select * from p where book = {book['twice']}
 union all select run, book, chapter_id + {FAR}, pos, word from p where book = {book['unknown']} and word in ({words})),
keys as (select distinct run, book, chapter_id from have),
lost as (select run, book, chapter_id, pos, pos - row_number() over (partition by run, book, chapter_id order by pos) as island from (select run, book, chapter_id, pos from p semi join keys using (run, book, chapter_id) except select run, book, chapter_id, pos from have))
select run, book, chapter_id, 'missing chapter' as fault, 1::bigint as first, n as last from sizes anti join keys using (run, book, chapter_id)
union all select run, book, chapter_id, 'unknown chapter', null, null from keys anti join chapters using (run, book, chapter_id)
union all select run, book, chapter_id, 'repeated token', pos, count(*) from have semi join chapters using (run, book, chapter_id) group by all having count(*) > 1
union all select run, book, chapter_id, 'token gap', min(pos), max(pos) from lost group by run, book, chapter_id, island)""")


#: Character references that the tables' pages have, with and without a semicolon; "&amp" comes last, lest what it leaves be taken for another.
_REFERENCES = {"copy": "©", "middot": "·", "quot": '"', "lt": "<", "gt": ">", "nbsp": " ", "amp": "&"}


def page_texts() -> str:
    """Table expression page_texts (page_id, url, text)."""
    rest, attributes = r"(?:[\s/][^>]*)?>", r"(?:[\s/](?:[^>\x22\x27]|\x22[^\x22]*\x22|\x27[^\x27]*\x27)*)?>"
    unseen = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(rf"<{x}{rest}.*?(?:</{x}\s*>|\z)" for x in html.HIDDEN)
    blank = lambda c: rf"regexp_replace({c}, '[\s\pZ\x{{0085}}]+', ' ', 'g')"
    line = "x"
    for name, c in _REFERENCES.items():
        line = f"regexp_replace({line}, '&{name};?', {_q(c)}, 'g')"
    return rf"""seen as (select page_id, url, regexp_replace(regexp_replace(coalesce(html, ''), {_q(unseen)}, '', 'g'), '(?is)\A.*?<body{rest}', '') as h from pages),
broken as (select page_id, url, regexp_replace(regexp_replace({blank("h")}, '(?is)</?(?:br|{"|".join(html.BLOCKS)}){attributes}', chr(10), 'g'), '(?is)<[a-z/!?](?:[^>]*>|[^>]*\z)', '', 'g') as h from seen),
page_texts as (select page_id, url, array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda x: trim({blank(line)})), lambda x: x <> ''), chr(10)) as text from broken)"""


def html_to_text() -> str:
    return f"with {page_texts()} select * from page_texts"


#: What books have around their texts, by the remainder of a page's id: nothing, marker lines, a list of contents, a library's imprint, or
#: nothing but that. The query puts it around the pages' texts.
MATTER = (
    ("", ""), MARKED, ("The Ferry\n\nContents\nChapter I.\nChapter II.\n\n\nChapter I.\n", "\nChapter II.\nNobody spoke."),
    ("Liber Liber\nQuesto e-book fu preparato\nTITOLO: Il faro\nAUTORE: N. N.\nhttp://example.org\n\nCapitolo I\n", ""), ("Questo e-book\nLiber Liber\nlicenza: libera", None),
)


def boilerplate_clean() -> str:
    """Cleaning line by line: a row for each line with its classes, and windows over them."""
    has = lambda c, phrases, how=any: "(" + (" and " if how is all else " or ").join(f"contains({c}, {_q(p)})" for p in phrases) + ")"
    library = lambda c: "(" + " or ".join(has(c, signs, all) for signs in K.LIBRARY_SIGNS) + ")"
    around = "case page_id % 5 " + " ".join(f"when {k} then {_q(a)}" + (f" || text || {_q(b)}" if b is not None else "") for k, (a, b) in enumerate(MATTER)) + " end"
    classes = ", ".join(f"regexp_matches(line, {_q(pattern)}) as is_{name}" for name, (_, pattern) in K.LINE_CLASSES.items())
    markers = " + ".join(f"contains(top, {_q(m)})::int" for m in K.LIBRARY_MARKERS)
    only = " or ".join(f"(markers >= {m} and imprint >= {i} and listed >= {n}{f' and words <= {w}' if w else ''} and long <= {long})" for m, i, n, w, long in K.FRONT_MATTER)
    heading = rf"(?i)^[^\S\n]*({K.HEADING})\s*$"
    lines = lambda source, column: f"""select page_id, i, line, sum(length(line) + 1) over (partition by page_id order by i) - length(line) - 1 as before
 from (select page_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from (select page_id, string_split({column}, chr(10)) as ls from {source}))"""  # noqa: E731
    return rf"""with {page_texts()},
pages_around as (select page_id, {around} as page from page_texts),
marked as materialized (select page_id, regexp_replace(regexp_replace(page, '(?i)(?m:^)\s*\*{{3}}\s*END OF (?:THE )?PROJECT GUTENBERG EBOOK(?s:.*)', ''), '(?i)^(?s:.*?)\n\s*\*{{3}}\s*START OF (?:THE )?PROJECT GUTENBERG EBOOK.*?\*{{3}}\s*', '') as text from pages_around),
lines1 as materialized ({lines("marked", "text")}),
names as (select page_id, i, before, lower(regexp_replace(regexp_replace(regexp_extract(line, {_q(heading)}, 1), '\s*\.*\s*$', ''), '\s+', ' ', 'g')) as name from lines1 where regexp_matches(line, {_q(heading)})),
numbered as (select *, row_number() over (partition by page_id, name order by i) as nth, first(name) over (partition by page_id order by i) as first_name from names),
again as (select page_id, before from numbered where name = first_name and nth = 2),
listed_at as (select page_id, min(before) as contents_before from lines1 where regexp_matches(line, '(?i)^\s*(?:contents|table of contents|indice|sommario)\s*$') group by page_id),
past_contents as materialized (select m.page_id, case when contents_before <= {K.CONTENTS_WITHIN} and length(regexp_replace(left(text, before::bigint), '\n\s*$', chr(10))) <= {K.REPEAT_WITHIN} then substr(text, before::bigint + 1) else text end as text
 from marked m left join again using (page_id) left join listed_at using (page_id)),
lines2 as materialized (select page_id, before, lower({trim("line")}) as line, row_number() over (partition by page_id order by i) as r from ({lines("past_contents", "text")}) where {trim("line")} <> ''),
coded as materialized (select page_id, before, r, {classes} from lines2),
tops as (select page_id, string_agg(line, chr(10) order by r) filter (r <= {K.LIBRARY_WITHIN}) as top from lines2 group by page_id),
fronts as (select page_id, max(r) as last from coded join tops using (page_id) where is_front and r <= {K.FRONT_WITHIN} and {library("top")} group by page_id),
near as (select c.*, last, max((is_words and not is_imprint and not is_listing)::int) over (partition by page_id order by r rows between 1 following and {K.FOLLOWED_WITHIN} following) = 1 as followed from coded c join fronts using (page_id)),
opened as (select page_id, arg_min(before, r) filter (is_opening or is_numeral and followed) as opening, arg_min(before, r) filter (is_long and not is_imprint) as prose
 from near where r > last and r <= last + {K.OPENING_WITHIN} group by page_id),
past_front as materialized (select p.page_id, {trim("case when coalesce(opening, prose) between 1 and " + str(K.START_WITHIN) + " then substr(text, coalesce(opening, prose)::bigint + 1) else text end")} as text from past_contents p left join opened using (page_id)),
lines3 as materialized (select page_id, lower({trim("line")}) as line, row_number() over (partition by page_id order by i) as r from ({lines("past_front", "text")}) where {trim("line")} <> ''),
sums as (select page_id, string_agg(line, chr(10) order by r) filter (r <= {K.LIBRARY_WITHIN}) as top, string_agg(line, chr(10) order by r) filter (r <= {K.TOP_LINES}) as head, bool_or(is_contents and r <= {K.CONTENTS_LINES}) as contents,
 sum(len(regexp_extract_all(line, '\p{{L}}+'))) as words, count(*) filter (is_long) as long, count(*) filter (is_imprint) as imprint, count(*) filter (is_imprint) + count(*) filter (is_listing) as listed, count(*) filter (is_heading) as headings
 from (select *, {classes} from lines3) group by page_id),
judged as (select *, {markers} as markers, {library("head")} as library, {has("top", K.LICENSED, all)} as licensed from sums)
select p.page_id, p.text, coalesce(library and (licensed and words <= {K.LICENSED_WORDS} and long <= {K.LICENSED_LONG} or {only}) or (library or contents) and long = 0 and headings >= {K.CHAPTER_LIST}, true) as is_front_matter
from past_front p left join judged using (page_id)"""
