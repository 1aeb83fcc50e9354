"""DuckDB SQL for the registered queries, written apart from the Spark expressions. Queries without an entry have no SQL form."""

from __future__ import annotations

from graphloom.functions import lexicons as L
from graphloom.operators import knowledge


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _norm(x: str) -> str:
    return _squeeze(f"lower(translate({x}, '।॥', '..'))")


def _tokens(x: str) -> str:
    return f"regexp_extract_all({_norm(x)}, '([\\p{{L}}\\p{{N}}_]+)', 1)"


def _space_tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda t: t <> '')"


def _answer(x: str) -> str:
    bare = f"regexp_replace(lower(coalesce({x}, '')), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"array_to_string(list_filter(string_split_regex({bare}, '\\s+'), lambda t: t not in ('', 'a', 'an', 'the')), ' ')"


def _answer_tokens(x: str) -> str:
    return f"list_filter(string_split({_answer(x)}, ' '), lambda t: t <> '')"


def _sentences(x: str) -> str:
    cut = f"string_split(regexp_replace({x}, '([.!?।॥])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 3)"


PAIRS = "pairs as (select conv_id, turn, text pred, gold from (select *, lead(text) over (partition by conv_id order by turn) gold from conversations) where gold is not null)"
TURNS = f"turns as (select conv_id doc_id, turn node_id, (turn // 4)::int page, role section, text, list_filter({_tokens('text')}, lambda w: length(w) >= 10) entities from conversations)"
SENTENCES = f"turns as (select doc_id, i - 1 node_id, s[i] text, list_filter({_tokens('s[i]')}, lambda w: length(w) >= 10) entities from (select doc_id, s, unnest(range(1, len(s) + 1)) i from (select doc_id, {_sentences('text')} s from documents)))"
#: Accented letters are word characters: as underscores they are so for a regular expression that knows ASCII words only.
MASKED = "regexp_replace(text, '[ªµºÀ-ÖØ-öø-ɏ]', '_', 'g')"
COSINE = """v as (select vec_id // 50 doc_id, vec_id node_id, embedding::double[] e from embeddings),
sims as (select a.doc_id, a.node_id src, b.node_id dst, list_cosine_similarity(a.e, b.e) sim from v a join v b on a.doc_id = b.doc_id and a.node_id < b.node_id)"""
KNN = f"""{COSINE},
th as (select doc_id, greatest(0.05, quantile_cont(sim, 0.80)) t from sims group by doc_id),
pass as (select s.* from sims s join th using (doc_id) where sim >= t),
dir as (select doc_id, src, dst, sim from pass union all select doc_id, dst, src, sim from pass),
near as (select doc_id, src, dst, sim from (select *, row_number() over (partition by doc_id, src order by sim desc, dst) n from dir) where n <= 3),
g as (select distinct on (doc_id, src, dst) doc_id graph, src, dst, round(sim, 6) weight from (select * from near union all select doc_id, dst, src, sim from near))"""
NODES = "nodes as (select graph, src node from g union select graph, dst from g)"
CAND = """c as (select source q_id, doc_id span_id, (doc_id * 37 % 101)::double / 101 sem, (n_chars % 97)::double lex, (doc_id % 13)::double cent, (doc_id % 5)::int overlap,
 doc_id % 3 = 0 sentence_overlap, (doc_id % 7)::int sentence_id, text from documents)"""
TRIPLES = f"""{SENTENCES},
flat as (select doc_id, node_id, unnest(entities) name, generate_subscripts(entities, 1) pos from turns),
trip as (select doc_id, node_id, pos, name subject, lead(name) over (partition by doc_id, node_id order by pos) object, case when length(name) % 2 = 0 then 'even' else 'odd' end label from flat),
t as (select * from trip where object is not null and subject <> object),
kg as (select doc_id, subject src, object dst, 'related_to' relation, count(*)::double weight from t group by 1, 2, 3)"""


def _rule(kind: str, pattern: str) -> str:
    groups = ", ".join(f"unnest(regexp_extract_all(text, {_q(pattern)}, {k})) {c}" for k, c in ((1, "x"), (2, "v"), (3, "y")))
    rows = f"(select doc_id, node_id, {groups} from turns)"
    if kind == "passive":
        return f"select doc_id, node_id, trim(y, ' ') subject, 'is ' || v || ' by' relation, x \"object\" from {rows}"
    if kind == "verb":
        return f"select doc_id, node_id, x, v, trim(y, ' ') from {rows} where v not in ('is', 'was', 'has', 'does')"
    return f"select doc_id, node_id, x, 'is', trim(y, ' ') from {rows} where not regexp_matches(y, '^\\p{{Ll}}+ed\\s+by\\s')"


def _cells(separator: str) -> str:
    return f"list_filter(list_transform(string_split_regex(trim(c, ' '), {separator}), lambda x: trim(x, ' ')), lambda x: x <> '')"


def _minmax(x: str) -> str:
    low, high = f"min({x}) over (partition by q_id)", f"max({x}) over (partition by q_id)"
    return f"(case when {high} > {low} then ({x} - {low}) / ({high} - {low}) else 0 end)"


def _bm25(tokens) -> str:
    return f"""d as (select doc_id, {tokens('text')} w from documents), n as (select count(*)::double n_docs, avg(len(w)) avgdl from d),
tf as (select doc_id, term, count(*)::double tf, any_value(dl) dl from (select doc_id, len(w)::double dl, unnest(w) term from d) group by 1, 2),
q as (select item_id, term, count(*)::double qtf from (select item_id, unnest({tokens('text')}) term from benchmark) group by 1, 2),
df as (select term, count(*)::double df from tf group by term),
s as (select q.item_id query, tf.doc_id doc, round(sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score
 from q join tf using (term) join df using (term), n group by 1, 2),
top as (select query, doc, score, rank::int rank from (select *, row_number() over (partition by query order by score desc, doc) rank from s) where rank <= 5)"""


def _prf(p: str, g: str, source: str) -> str:
    return f"""{source}, k as (select *, {_answer_tokens(p)} pt, {_answer_tokens(g)} gt, {_answer(p)} pa, {_answer(g)} ga from pairs),
m as (select *, coalesce(list_sum(list_transform(list_distinct(pt), lambda t: least(len(list_filter(pt, lambda x: x = t)), len(list_filter(gt, lambda x: x = t))))), 0)::double same, len(pt)::double np, len(gt)::double ng from k)"""


EVALUATED = f"""{_prf('pred', 'gold', PAIRS)}, v as (select conv_id * 1000 + turn q, case when turn % 2 = 0 then 'even' else 'odd' end lv, case when conv_id % 3 = 0 then 'bridge' else 'comparison' end ty, pa, ga, ng,
 case when same > 0 then 2 * (same / np) * (same / ng) / (same / np + same / ng) else 0.0 end f1 from m)"""


def _pagerank(steps: int) -> str:
    parts = [
        f"{KNN}, {NODES}, outw as (select graph, src, sum(weight) total from g group by 1, 2), sh as (select g.graph, g.src, g.dst, weight / total share from g join outw using (graph, src)), "
        "sz as (select graph, count(*)::double n from nodes group by 1), r0 as (select graph, node, n, 1 / n rank from nodes join sz using (graph))"
    ]
    for k in range(1, steps + 1):
        parts.append(
            f"r{k} as materialized (select r.graph, r.node, n, 0.15 / n + 0.85 * (coalesce(got, 0) + coalesce(lost, 0) / n) rank from r{k - 1} r "
            f"left join (select s.graph, s.dst node, sum(rank * share) got from sh s join r{k - 1} x on x.graph = s.graph and x.node = s.src group by 1, 2) using (graph, node) "
            f"left join (select graph, sum(rank) lost from r{k - 1} where not exists (select 1 from sh where sh.graph = r{k - 1}.graph and sh.src = r{k - 1}.node) group by 1) using (graph))"
        )
    return "with " + ",\n".join(parts) + f"\nselect graph, node, round(rank, 6) pagerank from r{steps}"


def _discourse(lexicon: dict[str, list[str]], x: str) -> str:
    tests = ", ".join("case when " + " or ".join(f"contains({x}, {_q(m)})" for m in ms) + f" then {_q(k)} end" for k, ms in lexicon.items())
    return f"list_filter([{tests}], lambda t: t is not null)"


SPANS = f"""{TURNS}, s as (select *, node_id // 2 sid, lead(node_id) over (partition by doc_id order by node_id) nxt from turns), m as (select *, {_discourse(L.DISCOURSE, 'lower(text)')} types from s), o as (select doc_id, node_id, unnest(entities) entity, generate_subscripts(entities, 1) pos from turns),
p as (select a.doc_id, a.node_id src, b.node_id dst from o a join o b on a.doc_id = b.doc_id and a.entity = b.entity and (a.node_id, a.pos) < (b.node_id, b.pos)),
e as (select a.doc_id, a.node_id src, b.node_id dst, 'same_sentence' "type", 1.0 weight, 2 prio from s a join s b on a.doc_id = b.doc_id and a.sid = b.sid and a.node_id <> b.node_id
 union all select doc_id, node_id, nxt, 'sequential', 0.9, 1 from s where nxt // 2 <> sid union all select doc_id, nxt, node_id, 'backward', 0.7, 1 from s where nxt // 2 <> sid
 union all select m.doc_id, m.node_id, t.node_id, types[-1], 0.85, 6 from m join s t on t.doc_id = m.doc_id and abs(t.sid - m.sid) <= 1 and t.node_id <> m.node_id where len(types) > 0
 union all select doc_id, src, dst, 'entity_overlap', 0.8, 7 from p union all select doc_id, dst, src, 'entity_overlap', 0.8, 7 from p)"""


def _title(x: str) -> str:
    letters = f"regexp_replace({x}, '[^\\p{{L}}]', '', 'g')"
    words = f"len(list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> ''))"
    title = f"({letters} <> '' and not regexp_matches({x}, '(^|[^\\p{{L}}])\\p{{Ll}}') and not regexp_matches({x}, '\\p{{L}}\\p{{Lu}}') and {words} <= 8)"
    capitals = f"({letters} <> '' and upper({x}) = {x} and not regexp_matches({x}, '\\p{{Ll}}') and {words} between 2 and 9)"
    return f"(length({x}) >= 4 and {words} >= 2 and (regexp_matches({x}, '^\\d+(\\.\\d+)*\\.?\\s+\\p{{L}}') or {title} or {capitals}))"


def _questions() -> str:
    forms = [
        "Are %1$s and %2$s both %3$s?",
        "Which %1$s was %2$s and %3$s?",
        "Who is older, %1$s or %2$s?",
        "Does %1$s %2$s that %3$s does not?",
        "When did the city of Paris have %1$s?",
        "Why is %1$s %2$s more than %3$s?",
        "What type of %1$s do %2$s and %3$s have in common?",
        "How is %1$s different from %2$s?",
        "Tell %1$s %2$s %3$s more and %4$s %1$s %2$s now",
    ]
    rows = []
    for k, f in enumerate(forms):
        x = _q(f)
        for n in range(1, 5):
            x = f"replace({x}, '%{n}$s', w[{n}])"
        rows.append(f"select item_id, {k} form, {x} question from w")
    return f"w as (select item_id, {_tokens('text')} w from benchmark), qs as ({' union all '.join(rows)}), questions as (select item_id, form, question, lower(question) low from qs where question is not null)"


def _class() -> str:
    whens = " ".join("when " + " or ".join(f"contains(low, {_q(w)})" for w in words) + f" then {_q(kind)}" for kind, words in L.QUESTION_CLASSES)
    return f"case {whens} else 'factual' end"


def _any(patterns: list[str], x: str) -> str:
    return f"regexp_matches({x}, {_q('(?i)' + '|'.join(f'(?:{p})' for p in patterns))})"


def _decompose() -> str:
    c = "trim(replace(question, '?', ''))"
    ex = lambda p, k: f"regexp_extract({c}, {_q(p)}, {k})"
    both = L.BOTH_SHARE
    acts = L.TWO_ACTS
    choice = L.CHOICE
    lacks = L.ONE_LACKS
    bridge = L.BRIDGE
    adjective = ex(choice, 2)
    for a, b in L.PLAIN_ADJECTIVE:
        adjective = f"replace({adjective}, '{a}', '{b}')"
    half = lambda k: f"trim(string_split({c}, ' and ')[{k}])"
    words = lambda k: f"len(string_split_regex({half(k)}, '\\s+'))"
    return f"""case when {_class()} not in ({', '.join(map(_q, L.DECOMPOSED))}) then question
when regexp_matches({c}, {_q(both)}) then 'Is ' || {ex(both, 1)} || ' ' || {ex(both, 3)} || '? | Is ' || {ex(both, 2)} || ' ' || {ex(both, 3)} || '?'
when regexp_matches({c}, {_q(acts)}) then {ex(acts, 1)} || {ex(acts, 2)} || ' ' || {ex(acts, 3)} || '? | ' || {ex(acts, 1)} || {ex(acts, 2)} || ' ' || {ex(acts, 4)} || '?'
when regexp_matches({c}, {_q(choice)}) then 'How ' || {adjective} || ' is ' || {ex(choice, 3)} || '? | How ' || {adjective} || ' is ' || {ex(choice, 4)} || '?'
when regexp_matches({c}, {_q(lacks)}) then 'What ' || {ex(lacks, 2)} || ' for ' || {ex(lacks, 1)} || '? | What ' || {ex(lacks, 2)} || ' for ' || {ex(lacks, 3)} || '?'
when regexp_matches({c}, {_q(bridge)}) then 'What is ' || {ex(bridge, 1)} || '? | ' || question
when len(string_split({c}, ' and ')) = 2 and {words(1)} > 2 and {words(2)} > 2 then {half(1)} || '? | ' || {half(2)} || '?' else question end"""


def _top(score: str, k: int = 10) -> str:
    return f"(select q_id, span_id, rank from (select q_id, span_id, row_number() over (partition by q_id order by {score} desc, span_id) rank from c) where rank <= {k})"


def _fuzzy(words: list[str], tokens: str) -> str:
    near = lambda w: f"len(list_filter({tokens}, lambda t: t = {_q(w)} or (length(t) >= 4 and {len(w)} >= 4 and (starts_with(t, {_q(w)}) or starts_with({_q(w)}, t))))) > 0"
    return " + ".join(f"(case when {near(w)} then 1 else 0 end)" for w in words)


ORACLES = {
    "sentence_split": f"select doc_id, len(s)::int n_sentences, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::int n_chars_kept, md5(array_to_string(s, chr(10))) sentences_md5 from (select doc_id, {_sentences('text')} s from documents)",
    "sentence_nodes": f"select doc_id, i - 1 node_id, (i - 1)::int sent_index, md5(s[i]) text_md5 from (select doc_id, s, unnest(range(1, len(s) + 1)) i from (select doc_id, {_sentences('text')} s from documents))",
    "section_detect": f"select doc_id, line, t title from (select doc_id, (i - 1)::int line, trim(l[i], ' ') t from (select doc_id, l, unnest(range(1, len(l) + 1)) i from (select doc_id, string_split(text, chr(10)) l from documents))) where {_title('t')}",
    "clause_split": "select conv_id, turn, len(c)::int n_clauses, md5(array_to_string(c, chr(10))) clauses_md5 from (select conv_id, turn, string_split(regexp_replace(regexp_replace(text, ':\\s+([A-Z])', chr(1) || '\\1', 'g'), ';\\s+', chr(1), 'g'), chr(1)) c from conversations)",
    "normalize_tokens": f"select doc_id, len(t)::int n_tokens, len(list_distinct(t))::int n_distinct, md5(array_to_string(t, ' ')) tokens_md5 from (select doc_id, {_tokens('text')} t from documents)",
    "answer_normalize": f"select item_id, {_answer('text')} answer, len({_answer_tokens('text')})::int n_tokens from benchmark",
    "page_sections": """with p as (select page_id page, regexp_extract(url, '://([^/:?#]+)', 1) doc_id, html from pages),
h as (select page, doc_id, case when page % 3 = 0 then trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) end raw from p),
t as (select page, doc_id, replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') title from h),
s as (select *, sum(case when title is not null then 1 else 0 end) over (partition by doc_id order by page rows unbounded preceding)::bigint section_id from t)
select doc_id, section_id, coalesce(arg_min(title, page), 'Introduction') title, string_agg(page::varchar, ',' order by page) pages from s group by 1, 2""",
    "html_pages": """with b as (select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) title,
 regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>|<head\\b.*?</head>', ' ', 'g') body from pages),
c as (select page_id, title, regexp_replace(regexp_replace(body, '(?i)</(p|div|li|h[1-6]|tr)>|<br\\s*/?>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g') body from b),
e as (select page_id, replace(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') title,
 replace(replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') body from c)
select page_id, title, trim(regexp_replace(regexp_replace(body, '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), ' ') body from e""",
    "pattern_entities": "select doc_id, entity, count(*) n from (" + " union all ".join(f"select doc_id, {_q(k + ':')} || lower(unnest(regexp_extract_all({MASKED}, {_q('(?i)(' + p + ')')}, 1))) entity from documents" for k, p in L.ENTITY_PATTERNS.items()) + ") group by 1, 2",
    "person_entities": f"select doc_id, entity, count(*) n from (select doc_id, 'PERSON/ORG:' || lower(unnest(regexp_extract_all({MASKED}, {_q('(' + L.ENTITY_PATTERNS['PERSON/ORG'] + ')')}, 1))) entity from documents) group by 1, 2",
    "discourse_types": f"select doc_id, array_to_string({_discourse(L.DISCOURSE, 'lower(text)')}, ',') types from documents",
    "bm25_topk": f"with {_bm25(_tokens)} select query, doc, score, rank from top",
    "rag_bm25_topk": f"with {_bm25(_space_tokens)} select query, doc, score, rank from top",
    "evidence_recall": f"with {_bm25(_tokens)} select b.item_id, coalesce(max(case when {_answer('b.text')} <> '' and contains({_answer('d2.text')}, {_answer('b.text')}) then 1.0 else 0.0 end), 0)::double recall_at_5 from benchmark b left join top on query = b.item_id left join documents d2 on d2.doc_id = top.doc group by 1",
    "em_f1": f"with {_prf('pred', 'gold', PAIRS)} select conv_id, turn, (pa = ga)::int::double em, round(case when np > 0 then same / np else 0 end, 6) \"precision\", round(case when ng > 0 then same / ng else 0 end, 6) recall, round(case when same > 0 then 2 * (same / np) * (same / ng) / (same / np + same / ng) else 0 end, 6) f1, (contains(ga, pa) or contains(pa, ga))::int::double substring from m",
    "f1_fallback": f"""with {_prf('pred', 'gold', PAIRS)},
num as (select *, try_cast(nullif(regexp_extract(pred, '([-+]?[0-9]*\\.?[0-9]+)', 1), '') as double) a, try_cast(nullif(regexp_extract(gold, '([-+]?[0-9]*\\.?[0-9]+)', 1), '') as double) b from m),
f as (select *, case when np = 0 and ng = 0 then 1.0 when np = 0 or ng = 0 then 0.0 when contains(ga, pa) or contains(pa, ga) then 0.6 when coalesce(abs(a - b) <= greatest(1e-6, 0.01 * greatest(abs(b), 1.0)), false) then 1.0 else 0.0 end::double fb from num)
select conv_id, turn, round(case when same > 0 then same / np else fb end, 6) "precision", round(case when same > 0 then same / ng else fb end, 6) recall, round(case when same > 0 then 2 * (same / np) * (same / ng) / (same / np + same / ng) else fb end, 6) f1 from f""",
    "metrics_by_level_type": "select lang \"level\", source \"type\", grouping(lang, source)::int \"grouping\", count(*) questions, coalesce(round(avg(quality::double), 4), 0) quality, coalesce(round(avg(toxic::double), 4), 0) toxic from documents join labels using (doc_id) group by grouping sets ((lang), (source), (lang, source), ())",
    "level_type_counts": "select source, count(*) questions, count(*) filter (where n_chars % 5 <> 0 and coalesce(text, '') not in ('', 'ERROR', 'No answer found')) answered, count(*) filter (where lang = 'en') en, count(*) filter (where lang = 'fr') fr from documents group by 1",
    "answer_summary": "with r as (select case when doc_id % 9 = 0 then 'No answer found' else text end pred, doc_id % 100 / 100 c from documents), k as (select coalesce(pred, '') not in ('', 'ERROR', 'No answer found') ok, c from r) select count(*) total_questions, count(*) filter (where ok) answered, count(*) filter (where not ok) unanswered, round(100.0::double * count(*) filter (where ok) / count(*), 1) answer_rate_pct, count(*) filter (where c >= 0.7) high, count(*) filter (where c < 0.7 and c >= 0.45) medium, count(*) filter (where c < 0.45) low from k",
    "stratified_sample": "with r as (select doc_id, lang \"level\", case when n_chars % 2 = 0 then 'bridge' else 'comparison' end \"type\" from documents), n as (select *, row_number() over (partition by \"level\", \"type\" order by doc_id * 7919 % 1009, doc_id)::int pick from r) select doc_id, \"level\", \"type\", pick from n where pick <= case \"level\" || ' ' || \"type\" when 'en bridge' then 5 when 'en comparison' then 6 when 'fr bridge' then 5 when 'fr comparison' then 5 when 'de bridge' then 5 when 'de comparison' then 5 else 0 end",
    "structural_edges": f"""with {TURNS}, o as (select *, row_number() over (partition by doc_id order by node_id) n from turns),
e as (select a.doc_id, a.node_id src, b.node_id dst, 'page' "type", 0.5 weight, 1 prio from o a join o b on a.doc_id = b.doc_id and a.page = b.page and a.node_id < b.node_id
union all select a.doc_id, a.node_id, b.node_id, 'adjacent', 1.0, 2 from o a join o b on a.doc_id = b.doc_id and b.n = a.n + 1
union all select a.doc_id, a.node_id, b.node_id, 'section', 0.6, 3 from o a join o b on a.doc_id = b.doc_id and a.section = b.section and a.section <> 'GLOBAL' and a.node_id < b.node_id
union all select a.doc_id, a.node_id, b.node_id, 'proximity', 1.0::double / (b.node_id - a.node_id), 4 from o a join o b on a.doc_id = b.doc_id and b.n - a.n between 1 and 3 and b.node_id - a.node_id between 2 and 3),
u as (select * from e union all select doc_id, dst, src, "type", weight, prio from e)
select doc_id, src, dst, arg_max("type", prio) "type", round(arg_max(weight, prio)::double, 6) weight from u group by 1, 2, 3""",
    "sequential_edges": f"""with s as (select conv_id doc_id, turn sentence_id, unnest(range(1, len(x) + 1)) pos from (select *, {_sentences('text')} x from conversations)),
n as (select doc_id, sentence_id, row_number() over (partition by doc_id order by sentence_id, pos)::int node_id from s),
l as (select *, lead(node_id) over (partition by doc_id order by node_id) nxt, lead(sentence_id) over (partition by doc_id order by node_id) ns from n)
select a.doc_id, a.node_id src, b.node_id dst, 'same_sentence' "type", 1.0::double weight from n a join n b on a.doc_id = b.doc_id and a.sentence_id = b.sentence_id and a.node_id <> b.node_id
union all select doc_id, node_id, nxt, 'sequential', 0.9 from l where ns <> sentence_id union all select doc_id, nxt, node_id, 'backward', 0.7 from l where ns <> sentence_id""",
    "discourse_edges": f"""with {TURNS}, m as (select doc_id, node_id, {_discourse({'addition': ['that is'], 'temporal': ['by th'], 'contrast': [' pour ']}, 'lower(text)')} types from turns)
select m.doc_id, m.node_id src, t.node_id dst, types[-1] "type", 0.85::double weight from m join turns t on t.doc_id = m.doc_id and abs(t.node_id - m.node_id) <= 1 and t.node_id <> m.node_id where len(types) > 0""",
    "cosine_threshold_edges": f"with {COSINE}, th as (select doc_id, greatest(0.05, quantile_cont(sim, 0.85)) t from sims group by doc_id), p as (select s.* from sims s join th using (doc_id) where sim >= t) select doc_id, src, dst, round(sim, 6) weight from p union all select doc_id, dst, src, round(sim, 6) from p",
    "knn_edges": f"with {KNN} select graph, src, dst, weight from g",
    "entity_edges": f"""with {SENTENCES}, m as (select doc_id, node_id, unnest(entities) entity, generate_subscripts(entities, 1) pos from turns),
p as (select a.doc_id, a.node_id src, b.node_id dst from m a join m b on a.doc_id = b.doc_id and a.entity = b.entity and (a.node_id, a.pos) < (b.node_id, b.pos))
select distinct doc_id, src, dst, 'entity' "type", 0.85::double weight from (select * from p union all select doc_id, dst, src from p)""",
    "mention_edges": f"""with {SENTENCES}, m as (select distinct doc_id, node_id::varchar s, 'entity::' || unnest(entities) e from turns)
select doc_id, s src, e dst, 'mentions' "type", 1.0::double weight from m union all select doc_id, e, s, 'mentioned_in', 1.0 from m""",
    "entity_relations": f"with {SENTENCES} select distinct doc_id, entities[1] src, entities[2] dst, 'entity_relation' \"type\", 0.9::double weight from turns where len(entities) >= 2 and entities[1] <> entities[2]",
    "text_mentions": f"with {TURNS}, k as (select distinct doc_id, unnest(entities) name from turns) select distinct t.doc_id, t.node_id, k.name from turns t join k using (doc_id) where list_contains({_tokens('t.text')}, k.name)",
    "degree": f"with {KNN} select graph, node, count(*) degree from (select graph, src node from g union all select graph, dst from g) group by 1, 2",
    "degree_centrality": f"with {KNN}, d as (select graph, node, count(*) degree from (select graph, src node from g union all select graph, dst from g) group by 1, 2) select graph, node, round(case when n > 1 then degree / (n - 1) else 1 end, 6) centrality from d join (select graph, count(*) n from d group by 1) using (graph)",
    "density": f"with {KNN}, {NODES} select graph, n nodes, e edges, case when n > 1 then round(e / (n * (n - 1)), 6) else 0 end density from (select graph, count(*) n from nodes group by 1) join (select graph, count(*) e from g group by 1) using (graph)",
    "pagerank_fixed": _pagerank(20),
    "khop": f"""with {KNN}, {NODES}, s as (select graph, node from nodes),
h1 as (select distinct s.graph, s.node start, g.dst node from s join g on g.graph = s.graph and g.src = s.node), h2 as (select distinct h1.graph, start, g.dst node from h1 join g on g.graph = h1.graph and g.src = h1.node),
a as (select graph, node start, node, 0 distance from s union all select graph, start, node, 1 from h1 union all select graph, start, node, 2 from h2) select graph, start, node, min(distance)::int distance from a group by 1, 2, 3""",
    "shortest_path_len": f"""with recursive {KNN}, {NODES}, u as (select graph, src, dst from g union select graph, dst, src from g), a as (select graph, node a from nodes),
r(graph, a, node, d) as (select graph, a, a, 0 from a union select r.graph, r.a, u.dst, d + 1 from r join u on u.graph = r.graph and u.src = r.node where d < 49)
select a.graph, a.a, n.node b, min(r.d)::int length from a join nodes n on n.graph = a.graph left join r on r.graph = a.graph and r.a = a.a and r.node = n.node group by 1, 2, 3""",
    "components": f"""with recursive {KNN}, {NODES}, u as (select graph, src, dst from g union select graph, dst, src from g),
r(graph, a, node) as (select graph, node, node from nodes union select r.graph, r.a, u.dst from r join u on u.graph = r.graph and u.src = r.node) select graph, a node, min(node) component from r group by 1, 2""",
    "traversal": f"""with {KNN}, {NODES}, t as (select *, case when weight > 0.15 then 'condition' else 'semantic' end "type" from g), d as (select graph, node, count(*) degree from (select graph, src node from g union all select graph, dst from g) group by 1, 2),
k as (select t.*, row_number() over (partition by t.graph, src order by degree desc, dst) n from t join d on d.graph = t.graph and d.node = t.dst), s as (select graph, src, dst from k where n <= 5 and "type" = 'condition'),
s0 as (select graph, node from nodes where node % 20 = 0), s1 as (select distinct s.graph, s.dst node from s join s0 on s0.graph = s.graph and s0.node = s.src where (s.graph, s.dst) not in (select graph, node from s0)),
s2 as (select distinct s.graph, s.dst node from s join s1 on s1.graph = s.graph and s1.node = s.src where (s.graph, s.dst) not in (select graph, node from s0 union select graph, node from s1)) select graph, node, 1 depth from s1 union all select graph, node, 2 from s2""",
    "diverse_by_section": "with r as (select conv_id q_id, turn span_id, role section, turn rank from conversations), a as (select *, case when row_number() over (partition by q_id, section order by rank) > 1 then 1 else 0 end again from r), p as (select *, row_number() over (partition by q_id order by again, rank)::int pick from a) select q_id, span_id, pick from p where pick <= 3",
    "minmax_fuse": f"with {CAND} select q_id, span_id, round(0.5 * {_minmax('sem')} + 0.3 * {_minmax('lex')} + 0.2 * {_minmax('cent')}, 6) score from c",
    "hybrid_rank": f"with {CAND}, b as (select * replace (sem + least(0.15::double, 0.03::double * overlap) + case when sentence_overlap then 0.03::double else 0 end as sem) from c), s as (select q_id, span_id, round(0.5 * {_minmax('sem')} + 0.3 * {_minmax('lex')} + 0.2 * {_minmax('cent')}, 6) score from b) select q_id, span_id, score, rank from (select *, row_number() over (partition by q_id order by score desc, span_id)::int rank from s) where rank <= 10",
    "rrf_merge": f"with {CAND}, l as (select * from {_top('sem', 20)} union all select * from {_top('lex', 20)}), f as (select q_id, span_id, sum(1.0::double / rank) rrf from l group by 1, 2) select q_id, span_id, round(rrf, 6) rrf, rank from (select *, row_number() over (partition by q_id order by rrf desc, span_id)::int rank from f) where rank <= 10",
    "candidate_union": f"with {CAND}, l as (select q_id, span_id, 1 h, 0 t, 0 k from {_top('sem')} union all select q_id, span_id, 0, 1, 0 from {_top('lex')} union all select q_id, span_id, 0, 0, 1 from {_top('cent')}) select q_id, span_id, max(h)::double in_hybrid, max(t)::double in_traversal, max(k)::double in_kg from l group by 1, 2",
    "ordered_dedup": f"with {CAND}, l as (select q_id, span_id, 0 l, rank from {_top('lex')} union all select q_id, span_id, 1, rank from {_top('sem')} union all select q_id, span_id, 2, rank from {_top('cent')}), f as (select q_id, span_id, min(l * 100 + rank) k from l group by 1, 2) select q_id, span_id, row_number() over (partition by q_id order by k, span_id)::int pos from f",
    "final_score": f"""with {CAND}, s as (select q_id, span_id, overlap, cent / 13 sentence, round(0.28 * sem + 0.18 * {_minmax('lex')} + 0.12 * (overlap::double / 5) + 0.10 * (cent / 13) + 0.08 * (cent / 26)
 + 0.06 * (span_id % 2 = 0)::int::double + 0.04 * (span_id % 3 = 0)::int::double + 0.03 * (span_id % 5 = 0)::int::double + 0.05 * (span_id % 7 = 0)::int::double + 0.06 * least(0.15::double, 0.05::double * (span_id % 4)), 6) score from c)
select q_id, span_id, score, score >= 0.12 and (overlap >= 1 or score >= 0.4 or sentence >= 0.5) relevant from s""",
    "answer_rank": f"""with {CAND}, r as (select q_id, span_id, sentence_id, text, span_id % 2 = 0 sent, sem, row_number() over (partition by q_id order by lex desc, span_id) pos from c),
o as (select *, {_fuzzy(['the', 'andxx', 'menteau'], _tokens('text'))} ov from r where pos <= 40),
s as (select *, round(sem + case when sent then 0.08 else 0 end + 0.2 * (ov::double / 3) + case when ov >= 2 then 0.08 when ov = 0 then -0.12 else 0 end - case when length(text) > 352 then 0.08 else 0 end - 0.0003::double * least(length(text), 600), 6)::double answer_score from o),
n as (select *, row_number() over (partition by q_id, sentence_id order by answer_score desc, pos) n from s), l as (select *, count(*) filter (where n <= 2) over (partition by q_id) lf from n)
select q_id, span_id, answer_score, row_number() over (partition by q_id order by answer_score desc, pos)::int rank from l where n <= 2 or lf < 3""",
    "answer_truncate": """with c as (select doc_id, text, text[1:220] cut from documents), p as (select *, greatest(case when contains(cut, '.') then 221 - strpos(reverse(cut), '.') else 0 end, case when contains(cut, '।') then 221 - strpos(reverse(cut), '।') else 0 end) dot from c)
select doc_id, case when length(text) <= 220 then text when dot - 1 > 132 then cut[1:dot] else rtrim(case when contains(cut, ' ') then cut[1:220 - strpos(reverse(cut), ' ')] else cut end, ' ') || '...' end answer from p""",
    "confidence": "with c as (select doc_id, round(0.4 * least(1.0::double, (doc_id % 150) / 100) + 0.6 * ((n_chars % 100) / 100), 6)::double confidence from documents) select doc_id, confidence, case when confidence >= 0.8 then 'High' when confidence >= 0.45 then 'Med' else 'Low' end label from c",
    "question_type": f"with {_questions()} select item_id, form, {_class()} \"class\" from questions",
    "comparison_type": f"with {_questions()} select item_id, form, case when {_any(L.DIFFERENCE, 'low')} then 'difference' when {_any(L.COMMON_PROPERTY, 'low')} then 'common_property' when {_any(L.BOOLEAN, 'low')} then 'boolean' when {_any(L.COMPARATIVE, 'low')} then 'comparative' else 'select_one' end \"type\" from questions",
    "decompose": f"with {_questions()} select item_id, form, {_decompose()} parts from questions",
    "kg_triples": f"with {TRIPLES} select doc_id, src, dst, relation, weight from kg",
    "kg_nodes": f"with {TRIPLES}, e as (select doc_id, subject x, label, node_id, pos from t union all select doc_id, object, null, node_id, pos from t) select doc_id, x \"text\", coalesce(arg_min(label, node_id * 100000 + pos) filter (where label is not null), 'entity') label, count(*) frequency from e group by 1, 2",
    "kg_stats": f"with {TRIPLES}, v as (select doc_id, src x from kg union select doc_id, dst from kg), n as (select doc_id, count(*) nodes from v group by 1), e as (select doc_id, count(*) edges from kg group by 1) select doc_id, nodes, edges, case when nodes > 1 then round(edges / (nodes * (nodes - 1)), 6) else 0 end density, labels from n join e using (doc_id) join (select doc_id, string_agg(label || '=' || c, ',' order by label) labels from (select doc_id, label, count(*) c from (select doc_id, x, coalesce(arg_min(label, node_id * 100000 + pos) filter (where label is not null), 'entity') label from (select doc_id, subject x, label, node_id, pos from t union all select doc_id, object, null, node_id, pos from t) group by 1, 2) group by 1, 2) group by 1) using (doc_id)",
    "kg_facts": f"""with {TRIPLES}, s as (select distinct doc_id, src start from kg), h1 as (select distinct s.doc_id, start, case when src = start then dst else src end n from s join kg on kg.doc_id = s.doc_id and (src = start or dst = start)),
seen as (select doc_id, start, start n, 1 hop from s union all select doc_id, start, n, 2 from h1), f as (select x.doc_id, start, src, relation, dst, max(weight) weight, min(hop) hop from seen x join kg on kg.doc_id = x.doc_id and (kg.src = x.n or kg.dst = x.n) group by 1, 2, 3, 4, 5),
k as (select *, row_number() over (partition by doc_id, start order by weight desc, hop, src, dst) r from f) select doc_id, start, string_agg(src || ' ' || relation || ' ' || dst, ' | ' order by r) facts from k where r <= 8 group by 1, 2""",
    "kg_chains": f"""with {TRIPLES}, s as (select distinct doc_id, src a from kg), d as (select kg.doc_id, a, dst z from s join kg on kg.doc_id = s.doc_id and kg.src = a),
f as (select s.doc_id, a, k1.dst b, k2.dst z from s join kg k1 on k1.doc_id = s.doc_id and k1.src = a join kg k2 on k2.doc_id = s.doc_id and k2.src = k1.dst where k2.dst <> a and (s.doc_id, a, k2.dst) not in (select doc_id, a, z from d))
select doc_id q_id, a || ' -> ' || z "text", 0.25::double score from d union all select doc_id, a || ' -> ' || min(b) || ' -> ' || z, round(0.5::double / 3, 6) from f group by doc_id, a, z""",
    "tfidf_importance": f"""with d as (select doc_id, list_filter({_tokens('text')}, lambda t: length(t) > 1 and not list_contains([{', '.join(map(_q, L.STOP_WORDS))}], t)) w from documents),
tf as (select doc_id, term, count(*)::double tf from (select doc_id, unnest(w) term from d) group by 1, 2), top as (select term, sum(tf) total, count(*)::double df from tf group by 1 order by total desc, term limit 100), n as (select count(*)::double n from documents),
x as (select doc_id, tf * (ln((1 + n) / (1 + df)) + 1) v from tf join top using (term), n), s as (select doc_id, sum(v) / sqrt(sum(v * v)) importance from x group by 1)
select d.doc_id, round(coalesce(importance, 0), 6) importance from documents d left join s using (doc_id)""",
    "rag_prompts": f"with {_bm25(_space_tokens)}, c as (select query item_id, string_agg(d2.text, chr(10) order by rank) x from top join documents d2 on d2.doc_id = top.doc group by 1) select b.item_id, 'Answer the question from the context with a short phrase.' || chr(10) || 'Context:' || chr(10) || x || chr(10) || 'Question: ' || b.text || chr(10) || 'Answer:' prompt from benchmark b join c using (item_id)",
    "kg_rule_triples": f"with {SENTENCES} " + " union all ".join(_rule(kind, p) for kind, p in knowledge.TRIPLE_RULES),
    "span_graph": f"with {SPANS} select doc_id, src, dst, arg_max(\"type\", prio) \"type\", arg_max(weight, prio)::double weight from e group by 1, 2, 3",
    "edge_type_counts": f"with {SPANS} select \"type\", count(*) n from (select doc_id, src, dst, arg_max(\"type\", prio) \"type\" from e group by 1, 2, 3) group by 1",
    "batch_evaluation": f"""with {EVALUATED}, r as (select lv "level", ty "type", case when q % 7 > 0 and pa = ga then 1.0 else 0.0 end em, case when q % 7 > 0 then f1 else 0.0 end f1 from v)
select "level", "type", grouping("level", "type")::int "grouping", count(*) questions, round(avg(em), 4) exact_match, round(avg(f1), 4) f1 from r group by grouping sets (("level"), ("type"), ("level", "type"), ())""",
    "system_metrics": f"""with {EVALUATED}, n as (select count(*) questions from v),
s as (select 'echo' system, count(*) answered, sum((pa = ga)::int) em, sum(f1) f1 from v union all select 'half', count(*), count(*), sum(case when ng > 0 then 1.0 else 0.0 end) from v where q % 2 = 0)
select system, questions, answered, round(em / questions, 4)::double exact_match, round(f1 / questions, 4)::double f1 from s, n""",
    "expansions": f"""with {_bm25(_tokens)}, x as (select query q_id, rank variant, b.text question, list_filter({_tokens('d2.text')}, lambda t: length(t) > 2 and not list_contains({_tokens('b.text')}, t))[1:4] fresh from top join documents d2 on d2.doc_id = top.doc join benchmark b on b.item_id = query where rank <= 3),
e as (select q_id, variant, question || ' ' || array_to_string(fresh, ' ') "query" from x where len(fresh) > 0 union all select item_id, 0, text from benchmark),
once as (select *, row_number() over (partition by q_id, {_norm('"query"')} order by variant) n from e) select q_id, variant, "query" from once where n = 1""",
    "closeness": f"""with recursive {KNN}, {NODES}, r(graph, a, node, d) as (select graph, node, node, 0 from nodes union select r.graph, r.a, g.src, d + 1 from r join g on g.graph = r.graph and g.dst = r.node where d < 49),
m as (select graph, a, node, min(d) d from r group by 1, 2, 3), s as (select graph, a node, count(*) - 1 k, sum(d) total from m group by 1, 2), n as (select graph, count(*) n from nodes group by 1)
select graph, node, case when total > 0 and n > 1 then k::double / total * k / (n - 1) else 0 end closeness from s join n using (graph)""",
    "spans": f"""with t as (select conv_id doc_id, turn sentence_id, text from conversations), c as (select *, string_split(regexp_replace(regexp_replace(text, ':\\s+([A-Z])', chr(1) || '\\1', 'g'), ';\\s+', chr(1), 'g'), chr(1)) p from t),
x as (select doc_id, sentence_id, p, unnest(range(1, len(p) + 1)) i from c where length(text) > 150 and len(p) > 1),
r as (select doc_id, sentence_id, 0 f, 0 pos, 'sentence' span_type, text, 0 a, length(text) b from t union all
 select doc_id, sentence_id, 2, i - 1, 'clause', p[i], coalesce(list_sum(list_transform(p[1:i - 1], lambda z: length(z))), 0), coalesce(list_sum(list_transform(p[1:i], lambda z: length(z))), 0) from x where length(p[i]) > 30),
o as (select *, row_number() over (partition by doc_id, sentence_id, lower(trim(text, ' ')) order by f, pos) n from r)
select doc_id, sentence_id, (row_number() over (partition by doc_id, sentence_id order by f, pos) - 1)::int ord, span_type, a::int start_char, b::int end_char, md5(text) text_md5 from o where n = 1""",
    "text_tables": f"""with l as (select doc_id, i, s[i] c from (select doc_id, s, unnest(range(1, len(s) + 1)) i from (select doc_id, string_split(text, chr(10)) s from documents))),
w as (select doc_id, i, {_cells("'[ \\t\\n\\v\\f\\r]{2,}'")} wide, {_cells("'[|\\t,]'")} narrow from l where trim(c, ' ') <> ''),
k as (select doc_id, i, case when len(wide) >= 2 then wide else narrow end cells from w), z as (select *, case when len(cells) >= 2 then len(cells) else 0 end width from k),
b as (select *, case when coalesce(lag(width) over (partition by doc_id order by i), -1) <> width then 1 else 0 end st from z),
t as (select *, sum(st) over (partition by doc_id order by i rows unbounded preceding)::bigint table_id from b)
select doc_id, table_id, count(*)::int n_rows, len(arg_min(cells, i))::int n_cells from t where width >= 2 group by 1, 2 having count(*) >= 2""",
    "system_comparison": "with d as (select lang, round(avg(quality::double), 4) exact_match, round(avg(toxic::double), 4) f1 from documents join labels using (doc_id) group by 1) " + " union all ".join(f"select '{m}' metric, " + ", ".join(f"coalesce(max(case when lang = '{x}' then printf('%.4f', {m}) end), 'N/A') {x}" for x in ("de", "en", "es", "fr")) + " from d" for m in ("exact_match", "f1")),
}
