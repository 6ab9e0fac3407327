"""SQL of the queries for another engine, written from the definitions and not from the plans."""

from __future__ import annotations

from ..functions.text import SPACE, WORD
from .queries import LEXICONS, MOODS, PARAMS


def _any(text: str, phrases, how: str = "contains") -> str:
    return "(" + " OR ".join(f"{how}({text}, '{p}')" for p in phrases) + ")"


_PIECES = rf"string_split(regexp_replace(text, '([.!?]){SPACE}+|\n', '\1' || chr(1), 'g'), chr(1))"
_FULL_PIECES = rf"string_split(regexp_replace(text, '([.!?]{SPACE}+|\n)', '\1' || chr(1), 'g'), chr(1))"
_STRIPPED = f"regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _words(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"


def _count(x: str) -> str:
    return f"len({_words(x)})"


_STATS = f"""
st AS (SELECT doc_id, source, text, list_transform({_PIECES}, lambda x: {_count('x')}) AS n FROM documents),
sl AS (SELECT *, list_filter(n, lambda x: x > 3) AS l FROM st),
sa AS (SELECT *, len(l)::DOUBLE AS k, coalesce(list_sum(l), 0)::DOUBLE AS s, coalesce(list_sum(list_transform(l, lambda x: x * x)), 0)::DOUBLE AS q FROM sl),
full_docs AS (SELECT *, length(text) >= 100 AND k > 0 AS ok FROM sa)
"""

SENTENCE_STATS = f"""WITH {_STATS} SELECT doc_id, len(n)::BIGINT AS n_sentences, list_sum(n)::BIGINT AS n_words, k::BIGINT AS n_long, s::BIGINT AS long_words FROM sa"""

_CHAOS = "CASE WHEN ok THEN round_even(sqrt(greatest(q / k - (s / k) * (s / k), 0.0)) / (s / k + 1) * 10, 2) ELSE 0.0 END"
CHAOS = f"WITH {_STATS} SELECT doc_id, {_CHAOS} AS chaos_score FROM full_docs"
CHAOS_TOP = f"WITH {_STATS} SELECT doc_id, {_CHAOS} AS chaos_score FROM full_docs ORDER BY chaos_score DESC, doc_id LIMIT 10"
COMPLEXITY = f"""
WITH {_STATS},
w AS (SELECT *, list_filter({_words('lower(text)')}, lambda x: regexp_full_match(x, '\\p{{L}}+')) AS a FROM full_docs)
SELECT doc_id, CASE WHEN ok THEN round_even(CASE WHEN len(a) > 0 THEN len(list_distinct(a))::DOUBLE / len(a) ELSE 0.0 END * 100 + s / k * 0.5, 2) ELSE 0.0 END AS complexity_score FROM w
"""
_MOOD = "CASE x " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MOODS.items()) + " END"
SENTIMENT = f"""
WITH w AS (SELECT doc_id, text, list_filter(list_transform({_words('lower(text)')}, lambda x: ({_MOOD})::DOUBLE), lambda x: x IS NOT NULL) AS m FROM documents)
SELECT doc_id, CASE WHEN length(text) >= 100 AND len(m) > 0 THEN round_even(list_sum(m) / len(m), 2) ELSE 0.0 END AS sentiment FROM w
"""
_HITS = " + ".join(f"len(string_split(lower(text), '{p}')) - 1" for p in LEXICONS.visual_triggers)
PHRASE_HITS = f"WITH {_STATS} SELECT doc_id, CASE WHEN ok THEN {_HITS} ELSE 0 END::BIGINT AS visual_event_count FROM full_docs"
_BUSINESS = f"""
bp AS (SELECT doc_id, list_transform({_FULL_PIECES}, lambda x: length(x)) AS c, list_transform({_FULL_PIECES}, lambda x: {_count('x')}) AS w FROM documents),
bf AS (SELECT doc_id, c, list_filter(range(0, greatest(len(w) - 10, 0), 5), lambda i: list_sum(w[i + 1:i + 10]) > 150)[1] AS i FROM bp),
bs AS (SELECT doc_id, CASE WHEN i IS NULL THEN 0 ELSE coalesce(list_sum(c[1:i]), 0) END::BIGINT AS start_at FROM bf)
"""
BUSINESS = f"WITH {_STATS}, {_BUSINESS} SELECT doc_id, CASE WHEN ok THEN start_at ELSE 0 END::BIGINT AS business_start_index FROM full_docs JOIN bs USING (doc_id)"

_STOP = ", ".join(f"'{x}'" for x in LEXICONS.stop_concepts)
_CONCEPTS = f"""
cw AS (SELECT doc_id, list_filter({_words('lower(text)')}, lambda x: length(x) > 3 AND x NOT IN ({_STOP})) AS w FROM documents WHERE length(text) >= 100),
ce AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM cw),
cc AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM ce GROUP BY ALL),
tc AS (SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM cc QUALIFY rank <= 8)
"""
TOP_CONCEPTS = f"WITH {_CONCEPTS} SELECT doc_id, term, n, rank FROM tc"

_GRAMS = "list_transform(range(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 5], ' '))"
_MINED = f"""
gw AS (SELECT doc_id, {_words('lower(text)')} AS w FROM documents),
gg AS (SELECT unnest(list_distinct({_GRAMS})) AS gram FROM gw),
mined AS (SELECT gram, count(*) AS df FROM gg GROUP BY gram HAVING count(*) >= 5)
"""
_SAFE = f"(NOT {_any('gram', LEXICONS.keywords)} AND {_any('gram', LEXICONS.safe_starters, 'starts_with')})"
NGRAMS = f"WITH {_MINED} SELECT gram, df FROM mined"
TOXIC = f"WITH {_MINED} SELECT gram, df FROM mined WHERE NOT {_SAFE}"
_BOILER = ", ".join(f"'{x}'" for x in LEXICONS.boilerplate)
_RULES = f"""
{_MINED},
toxic AS (SELECT gram FROM mined WHERE NOT {_SAFE}),
rp AS (SELECT doc_id, list_transform({_PIECES}, lambda x: {_STRIPPED}) AS p FROM documents),
rs AS (SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) - 1 AS pos FROM rp),
rt AS (SELECT *, lower(sentence) AS low FROM rs WHERE sentence <> ''),
ru AS (SELECT *, CASE WHEN regexp_replace(low, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') IN ({_BOILER}) THEN 1
                      WHEN {_any('low', LEXICONS.sponsors)} AND {_any('low', LEXICONS.keywords)} THEN 2 ELSE 0 END AS rule FROM rt),
rw AS (SELECT doc_id, pos, {_words('low')} AS w FROM ru WHERE rule = 0 AND length(sentence) > 30),
rg AS (SELECT doc_id, pos, unnest({_GRAMS}) AS gram FROM rw),
rh AS (SELECT DISTINCT doc_id, pos FROM rg SEMI JOIN toxic USING (gram)),
rules AS (SELECT ru.doc_id, ru.pos, sentence, CASE WHEN rule = 0 AND rh.pos IS NOT NULL THEN 3 ELSE rule END AS rule
          FROM ru LEFT JOIN rh ON ru.doc_id = rh.doc_id AND ru.pos = rh.pos)
"""
AD_RULES = f"""WITH {_RULES} SELECT doc_id, sum((rule = 0)::INT)::BIGINT AS rule_0, sum((rule = 1)::INT)::BIGINT AS rule_1,
sum((rule = 2)::INT)::BIGINT AS rule_2, sum((rule = 3)::INT)::BIGINT AS rule_3 FROM rules GROUP BY doc_id"""
_SILVER = f"""{_RULES},
silver AS (SELECT d.doc_id, coalesce(string_agg(sentence, ' ' ORDER BY pos) FILTER (rule = 0), '') AS body, coalesce(sum((rule > 0)::INT), 0)::BIGINT AS removed
           FROM documents d LEFT JOIN rules r ON d.doc_id = r.doc_id GROUP BY d.doc_id)"""
CLEAN = f"WITH {_SILVER} SELECT doc_id, md5(body) AS digest, length(body)::BIGINT AS chars, removed AS ads_removed_count FROM silver"
SUMMARY = f"WITH {_SILVER} SELECT count(*) AS docs, sum(removed)::BIGINT AS removed, round_even(avg(removed), 2) AS mean_removed FROM silver"

#: Chunk bounds by recursion over sentences; ``pre`` holds running sums of lengths, so the overlap is a count.
_BOUNDS = f"""
kp AS (SELECT doc_id, {_PIECES} AS p FROM documents WHERE length(text) > 0),
kl AS (SELECT doc_id, list_transform(p, lambda x: length(x)) AS l FROM kp),
kb AS (SELECT doc_id, l, list_transform(range(0, len(l) + 1), lambda i: coalesce(list_sum(l[1:i]), 0)::BIGINT) AS pre FROM kl),
fold AS (
  SELECT doc_id, l, pre, 0::BIGINT AS i, 1::BIGINT AS first, 0::BIGINT AS size, NULL::BIGINT AS cf, NULL::BIGINT AS cl FROM kb
  UNION ALL
  SELECT doc_id, l, pre, i + 1, CASE WHEN closes THEN nf ELSE first END, CASE WHEN closes THEN pre[i + 1] - pre[nf] + l[i + 1] ELSE size + l[i + 1] END,
         CASE WHEN closes THEN first END, CASE WHEN closes THEN i END
  FROM (SELECT *, size + l[i + 1] > 1000 AND size >= 50 AS closes, greatest(first, 1 + len(list_filter(pre[1:i + 1], lambda x: pre[i + 1] - x > 200))) AS nf
        FROM fold WHERE i < len(l)) AS step
),
kc AS (SELECT doc_id, cf AS first, cl AS last FROM fold WHERE cf IS NOT NULL UNION ALL SELECT doc_id, first, i FROM fold WHERE i = len(l)),
ko AS (SELECT kc.doc_id, first, last, row_number() OVER (PARTITION BY kc.doc_id ORDER BY last, first) - 1 AS ordinal, array_to_string(p[first:last], ' ') AS body
       FROM kc JOIN kp ON kc.doc_id = kp.doc_id)
"""
CHUNK_BOUNDS = f"WITH RECURSIVE {_BOUNDS} SELECT doc_id, ordinal::INT AS ordinal, first::INT AS first, last::INT AS last, length(body)::BIGINT AS chars FROM ko"
_HOST = " + ".join(["0.0::DOUBLE", *(f"CASE WHEN contains(lower(body), '{m}') THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END" for m in LEXICONS.host_markers), "CASE WHEN contains(body, '?') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END", f"CASE WHEN contains(lower(body), '{LEXICONS.extra_marker}') THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END"])
_CHUNKS = f"""{_BOUNDS}, {_STATS}, {_BUSINESS},
chunk AS (SELECT format('{{:d}}-{{:04d}}', ko.doc_id, ordinal) AS chunk_id, ko.doc_id, d.source, body,
                 CASE WHEN ok AND start_at > 0 AND ordinal < 2 THEN 'Feedforward' ELSE 'Business' END AS stage, least(1.0::DOUBLE, {_HOST}) AS host_probability,
                 {_any('lower(body)', LEXICONS.chunk_visual_triggers)} AS has_visual_context, {_CHAOS} AS episode_chaos
          FROM ko JOIN full_docs d ON ko.doc_id = d.doc_id JOIN bs ON ko.doc_id = bs.doc_id)
"""
CHUNK_FEATURES = f"WITH RECURSIVE {_CHUNKS} SELECT chunk_id, stage, host_probability, has_visual_context, episode_chaos, md5(body) AS digest FROM chunk"
HOST = f"WITH RECURSIVE {_CHUNKS} SELECT chunk_id, stage, host_probability AS score, md5(body) AS digest FROM chunk WHERE host_probability >= 0.15 AND NOT has_visual_context AND length(body) > 50"
VISUAL = f"WITH RECURSIVE {_CHUNKS} SELECT chunk_id, md5(body) AS digest FROM chunk WHERE has_visual_context"

_GRAPH = f"""{_CHUNKS}, {_CONCEPTS},
ep AS (SELECT doc_id, any_value(source) AS source, count(*) AS n_chunks, max(chunk_id) AS last_chunk, max(episode_chaos) > {PARAMS.chaos_cut} AS chaos FROM chunk GROUP BY doc_id),
vc AS (SELECT term AS id, sum(n_chunks)::BIGINT AS n FROM tc JOIN ep USING (doc_id) GROUP BY term HAVING sum(n_chunks) >= 2),
vt AS (SELECT tc.doc_id, term, rank FROM tc SEMI JOIN vc ON term = id),
de AS (SELECT ep.doc_id, source, term AS target, 'DISCUSSED' AS type, 1.0::DOUBLE AS weight FROM ep JOIN vt ON ep.doc_id = vt.doc_id),
ce2 AS (SELECT a.doc_id, a.term AS source, b.term AS target, 'CO_OCCURRENCE' AS type, 0.5::DOUBLE AS weight FROM vt a JOIN vt b ON a.doc_id = b.doc_id AND a.rank < b.rank),
rows_ AS (SELECT * FROM de UNION ALL SELECT * FROM ce2),
edge AS (SELECT r.source, target, type, chunk_id, chaos, weight FROM rows_ r JOIN chunk USING (doc_id) JOIN ep USING (doc_id)),
up AS (SELECT r.source, target, type, max(last_chunk) AS chunk_id, arg_max(chaos, last_chunk) AS chaos, sum(n_chunks)::BIGINT AS mentions, sum(n_chunks * weight) AS weight
       FROM rows_ r JOIN ep USING (doc_id) GROUP BY ALL)
"""


def _graph(select: str) -> str:
    return f"WITH RECURSIVE {_GRAPH} {select}"


CONCEPT_ROWS = _graph("SELECT id, n FROM vc")
NODES = _graph("SELECT DISTINCT source AS id, 'PERSON' AS type FROM ep UNION ALL SELECT id, 'CONCEPT' FROM vc")
DISCUSSED = _graph("SELECT * FROM edge WHERE type = 'DISCUSSED'")
COOCCUR = _graph("SELECT * FROM edge WHERE type = 'CO_OCCURRENCE'")
UPSERT = _graph("SELECT * FROM up")
AUTHORITY = _graph("SELECT source AS guest, mentions FROM up WHERE type = 'DISCUSSED' AND target = 'that' ORDER BY mentions DESC, guest LIMIT 5")
CHAOS_EDGES = _graph("SELECT chunk_id AS chunk, source AS guest, target AS concept FROM edge WHERE type = 'DISCUSSED' AND chaos")
_NEIGHBOURS = """SELECT * FROM (SELECT source AS entity, type AS rel, target AS connected_to, chunk_id AS chunk FROM edge WHERE type = 'DISCUSSED'
UNION ALL SELECT target, type, source, chunk_id FROM edge WHERE type = 'DISCUSSED') WHERE contains(lower(entity), 'src1') ORDER BY entity, connected_to, chunk LIMIT 10"""
NEIGHBOURS = _graph(_NEIGHBOURS)
SHORTEST = _graph("""
, dl AS (SELECT DISTINCT source, target FROM up WHERE type = 'DISCUSSED'),
two AS (SELECT ['src0', min(a.target), 'src1'] AS path FROM dl a JOIN dl b ON a.target = b.target WHERE a.source = 'src0' AND b.source = 'src1' HAVING count(*) > 0),
four AS (SELECT min(['src0', a.target, b.source, c.target, 'src1']) AS path FROM dl a JOIN dl b ON a.target = b.target JOIN dl c ON b.source = c.source JOIN dl d ON c.target = d.target
         WHERE a.source = 'src0' AND d.source = 'src1' AND b.source NOT IN ('src0', 'src1') AND NOT EXISTS (FROM two) HAVING count(*) > 0),
best AS (SELECT path FROM two UNION ALL SELECT path FROM four)
SELECT (generate_subscripts(path, 1) - 1)::INT AS hop, unnest(path) AS id FROM best
""")

_UNIT = """
vn AS (SELECT vec_id, label, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS length FROM embeddings),
vu AS (SELECT vec_id, label, length, CASE WHEN length > 0 THEN list_transform(e, lambda x: (x::DOUBLE / length)::FLOAT) ELSE e END AS v FROM vn)
"""
NORMS = f"WITH {_UNIT} SELECT vec_id, round(length, 5) AS length, round(sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS unit_length FROM vu"
_MEANS = f"""{_UNIT},
vx AS (SELECT label, generate_subscripts(v, 1) AS pos, unnest(v)::DOUBLE AS x FROM vu),
vm AS (SELECT label, pos, avg(x) AS x FROM vx GROUP BY ALL),
vc AS (SELECT label AS query_id, list(x ORDER BY pos) AS q FROM vm GROUP BY label),
vd AS (SELECT query_id, vec_id, list_sum(list_transform(range(1, len(q) + 1), lambda i: (v[i]::DOUBLE - q[i]) * (v[i]::DOUBLE - q[i]))) AS distance FROM vu, vc),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM vd QUALIFY rank <= 3)
"""
CENTROIDS = f"WITH {_MEANS} SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM hits"
_NEAR = f"""{_UNIT},
vd AS (SELECT a.vec_id AS query_id, a.label AS label, b.vec_id, b.label AS found, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (b.v[i]::DOUBLE - a.v[i]::DOUBLE) * (b.v[i]::DOUBLE - a.v[i]::DOUBLE))) AS distance
       FROM vu a JOIN vu b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM vd QUALIFY rank <= 3)
"""
KNN = f"WITH {_NEAR} SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM hits"
AGREEMENT = f"WITH {_NEAR} SELECT label, count(DISTINCT query_id) AS queries, round_even(100 * avg((label = found)::INT), 2) AS agreement FROM hits GROUP BY label"

HISTORY = "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) <= 4"
STEPS = "WITH c AS (SELECT conv_id, max((role = 'system')::INT) AS r FROM conversations GROUP BY conv_id) SELECT count(*) AS runs, round_even(100 * avg(r), 2) AS rate FROM c"
LATENCY = "SELECT count(*) AS prompts, round_even(avg(value), 2) AS mean_latency, round_even(100 * avg((event_type = 'click')::INT), 2) AS correction_rate FROM events"
TRACES = """SELECT event_type AS input, 'N/A' AS output, round_even(CAST(trunc(value * 1000) AS BIGINT) / 1000, 2) AS latency, 'success' AS status
FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id LIMIT 20"""
TOKENS = f"SELECT count(*) AS files, sum({_count('text')})::BIGINT AS tokens FROM documents"
FILES = r"""
WITH f AS (SELECT ['The Experience #', 'MMA Show #', 'the experience  #', 'Best of #'][doc_id % 4 + 1] || doc_id || [' - ', ' with ', '-', ' - with '][doc_id % 4 + 1]
                  || source || ['.txt', ' (Part Two).txt', ' (part 3) .txt'][doc_id % 3 + 1] AS name FROM documents),
b AS (SELECT name, trim(replace(name, '.txt', '')) AS bare FROM f),
p AS (SELECT *, lower(regexp_extract(bare, '(?i)\(Part\s*(\d+|One|Two|Three)\)', 1)) AS part FROM b),
s AS (SELECT *, CASE part WHEN '' THEN '' WHEN 'one' THEN '-1' WHEN 'two' THEN '-2' WHEN 'three' THEN '-3' ELSE '-' || part END AS suffix,
             regexp_extract(bare, '(?i)Experience\s*#(\d+)\s*-\s*(.*)', ['n', 'g']) AS j, regexp_extract(bare, '(?i)MMA Show\s*#(\d+)\s*(?:-\s*with\s*|-\s*|with\s*)(.*)', ['n', 'g']) AS m FROM p)
SELECT name, CASE WHEN j.n <> '' THEN 'JRE-' || j.n || suffix WHEN m.n <> '' THEN 'MMA-' || m.n || suffix ELSE 'Special-' || regexp_replace(bare, '[^a-zA-Z0-9]', '_', 'g') END AS episode_id,
       CASE WHEN j.n <> '' THEN 'JRE' WHEN m.n <> '' THEN 'MMA' ELSE 'Special' END AS show_type,
       CASE WHEN j.n <> '' THEN trim(j.g) WHEN m.n <> '' THEN trim(m.g) ELSE 'Unknown' END AS guest_draft FROM s
"""
AUDIT = "SELECT url || '#' || page_id AS name, strlen(html)::BIGINT AS length, strlen(html) < 1500 AS too_small, true AS valid_utf8 FROM pages"
HYBRID = f"""
WITH RECURSIVE {_GRAPH}, {_UNIT},
fx AS ({_NEIGHBOURS}),
mx AS (SELECT generate_subscripts(v, 1) AS pos, unnest(v)::DOUBLE AS x FROM vu),
mm AS (SELECT pos, avg(x) AS x FROM mx GROUP BY pos),
mq AS (SELECT list(x ORDER BY pos) AS q FROM mm),
mh AS (SELECT vec_id, label FROM vu, mq ORDER BY list_sum(list_transform(range(1, len(q) + 1), lambda i: (v[i]::DOUBLE - q[i]) * (v[i]::DOUBLE - q[i]))), vec_id LIMIT 3)
SELECT 0 AS side, 'Graph Fact: entity: ' || entity || ' | rel: ' || rel || ' | connected_to: ' || connected_to || ' | chunk: ' || chunk AS text, 'GRAPH' AS chunk_id, 0.0::DOUBLE AS chaos FROM fx
UNION ALL SELECT 1, 'label ' || label, vec_id::VARCHAR, 0.0::DOUBLE FROM mh
"""
PREVIEW = "SELECT doc_id, replace(substr(text, 1, 100), chr(10), ' ') || '...' AS preview FROM documents"
BY_DAY = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"

_SCHEMA = "SELECT 'label' AS kind, type AS name FROM (SELECT 'PERSON' AS type FROM ep UNION SELECT 'CONCEPT' FROM vc) UNION SELECT 'relationship', type FROM edge"
GRAPH_SCHEMA = _graph(_SCHEMA)
EPISODES = _graph("""
, tl AS (SELECT doc_id, string_agg(term, ',' ORDER BY rank) AS concepts FROM tc GROUP BY doc_id)
SELECT ep.doc_id AS episode_id, CASE WHEN n_chunks > 1 THEN source ELSE '' END AS guests, coalesce(concepts, '') AS concepts, n_chunks, last_chunk, chaos FROM ep LEFT JOIN tl ON ep.doc_id = tl.doc_id
""")
_BLOCKED = ", ".join(f"'{x}'" for x in LEXICONS.blocked_names)
GUESTS = f"""WITH {_SILVER},
gn AS (SELECT doc_id, list_filter(regexp_extract_all(body, '\\p{{Lu}}[\\p{{Ll}}]+ \\p{{Lu}}[\\p{{Ll}}]+'), lambda x: length(x) > 3 AND lower(x) NOT IN ({_BLOCKED})) AS l FROM silver)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:5], '|') AS guests FROM gn"""
SAMPLED = f"WITH {_MINED.replace('FROM documents', 'FROM (SELECT * FROM documents ORDER BY md5(doc_id || chr(58) || 42), doc_id LIMIT 300)')} SELECT gram, df FROM mined"
BRONZE = FILES.replace("SELECT name, CASE WHEN j.n", "SELECT name AS original_filename, md5(text) AS digest, len(pieces)::BIGINT AS n_sentences, CASE WHEN j.n").replace("AS name FROM documents)", f"AS name, text, {_PIECES} AS pieces FROM documents)").replace("SELECT name, trim", "SELECT name, text, pieces, trim")
AUDIT_LINES = f"""
WITH a AS ({AUDIT}),
s AS (SELECT ['files: ' || count(*), 'too small: ' || sum(too_small::INT), 'unreadable: ' || sum((NOT valid_utf8)::INT)] AS l FROM a)
SELECT unnest(l) AS value FROM s UNION ALL SELECT 'small: ' || name || ' (' || length || ' bytes)' FROM a WHERE too_small UNION ALL SELECT name FROM a"""
AUDIT_SUMMARY = f"WITH a AS ({AUDIT}) SELECT count(*) AS files, sum(too_small::INT)::BIGINT AS too_small, sum((NOT valid_utf8)::INT)::BIGINT AS unreadable FROM a"
REPLIES = f"SELECT conv_id, turn, role, md5({_STRIPPED.replace('(x,', '(trim(text),')}) AS digest FROM conversations"
EXPORTS = "SELECT unnest(['csv', 'jsonl', 'lines', 'parquet']) AS kind, count(*) AS n, sum(doc_id)::BIGINT AS ids, sum(length('a \"quoted\", ' || source))::BIGINT AS chars FROM documents"

INDEXED = _graph("""
, sides AS (SELECT source AS entity, target AS connected_to, chunk_id AS chunk FROM edge WHERE type = 'DISCUSSED' UNION ALL SELECT target, source, chunk_id FROM edge WHERE type = 'DISCUSSED')
SELECT asked, entity, connected_to, count(*) AS n, min(chunk) AS first_chunk FROM sides, (VALUES ('SRC1'), ('rc0'), ('tha'), ('HE'), ('zzzz')) AS a(asked) WHERE contains(lower(entity), lower(asked)) GROUP BY ALL
""")
_LEX = f"""
WITH w AS (SELECT {_words('lower(text)')} AS w FROM benchmark),
three AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' '))) AS phrase FROM w),
long AS (SELECT DISTINCT x AS phrase FROM (SELECT unnest(w) AS x FROM w) WHERE length(x) >= 9),
d AS (SELECT doc_id, lower(text) AS text FROM documents)
"""
_TIMES = "((length(text) - length(replace(text, phrase, ''))) // length(phrase))"
LEXICON_HITS = f"{_LEX} SELECT doc_id, phrase, {_TIMES}::BIGINT AS n FROM d, three WHERE contains(text, phrase)"
LEXICON_DOCS = f"{_LEX} SELECT doc_id, sum({_TIMES})::BIGINT AS hits FROM d, long WHERE contains(text, phrase) GROUP BY doc_id"
KNN_PARTS = """
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice::DOUBLE AS b FROM part),
d AS (SELECT q.p_partkey AS query_id, p.p_partkey, (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) AS distance FROM p q JOIN p ON p.p_partkey <> q.p_partkey WHERE q.p_partkey % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, p_partkey)::INT AS rank, p_partkey, round(distance, 6) AS distance FROM d QUALIFY rank <= 5
"""

_PAIRS = f"""
w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {_words('lower(text)')} AS w FROM documents)),
v AS (SELECT word FROM w GROUP BY word HAVING count(DISTINCT doc_id) >= greatest(3, 0.01 * (SELECT count(*) FROM documents))),
k AS MATERIALIZED (SELECT w.* FROM w JOIN v USING (word)),
p AS MATERIALIZED (SELECT x.word AS word_a, y.word AS word_b, count(*) AS n FROM k x JOIN k y ON x.doc_id = y.doc_id AND abs(x.pos - y.pos) BETWEEN 1 AND 4 GROUP BY ALL),
s AS (SELECT word_a AS word, sum(n) AS s FROM p GROUP BY ALL),
pm AS MATERIALIZED (SELECT word_a, word_b, n, greatest(ln(n * (SELECT sum(n) FROM p)::DOUBLE / (a.s::DOUBLE * b.s)), 0) AS m FROM p JOIN s a ON a.word = word_a JOIN s b ON b.word = word_b)
"""
WORD_PAIRS = f"WITH {_PAIRS} SELECT word_a, word_b, n, round(m, 6) AS m FROM pm"
_SEEDS = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in MOODS.items())
_SPREAD = """SELECT word_a AS word, 0.85 * sum(m * score) / sum(m) AS score FROM pm JOIN {} AS r ON r.word = word_b WHERE m > 0 AND word_a NOT IN (SELECT word FROM m0) GROUP BY ALL UNION ALL FROM m0"""
_MOODS = f"{_PAIRS}, m0(word, score) AS (VALUES {_SEEDS}), m1 AS MATERIALIZED ({_SPREAD.format('m0')}), m2 AS MATERIALIZED ({_SPREAD.format('m1')})"
INDUCED_LEXICON = f"WITH {_MOODS} SELECT word, round(score, 6) AS score FROM m2"
INDUCED_SENTIMENT = f"""WITH {_MOODS},
a AS (SELECT doc_id, {_words('lower(text)')} AS w FROM documents),
c AS (SELECT doc_id, unnest(w) AS word, unnest(list_transform(range(1, len(w) + 1), lambda i: w[greatest(i - 3, 1):i - 1])) AS x FROM a),
e AS (SELECT doc_id, count(*) AS words, avg(score * CASE WHEN list_has_any(x, ['of', 'que']) THEN -1.0 ELSE 1.0 END * CASE WHEN list_has_any(x, ['that', 'der']) THEN 1.5 ELSE 1.0 END) AS score
      FROM c JOIN m2 USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(words, 0) AS words, round(coalesce(score, 0.0), 6) AS score FROM documents LEFT JOIN e USING (doc_id)"""
ABBREVIATIONS = r"""
WITH k AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_.''-]*')) AS token FROM documents),
c AS (SELECT regexp_replace(token, '\.+$', '') AS word, sum((NOT ends_with(token, '.'))::INT)::BIGINT AS bare, sum(ends_with(token, '.')::INT)::BIGINT AS dotted FROM k GROUP BY 1),
l AS (SELECT * FROM c WHERE regexp_matches(word, '\p{L}')),
t AS (SELECT least(greatest(sum(dotted) / sum(bare + dotted), 1e-9), 0.99 - 1e-9) AS p FROM l),
r AS (SELECT *, length(replace(word, '.', ''))::DOUBLE AS z, 2 * (dotted * (ln(0.99) - ln(p)) + bare * (ln(1 - 0.99) - ln(1 - p))) AS ratio FROM l, t WHERE dotted > 0),
s AS (SELECT word, bare, dotted, ratio * exp(-z) * (length(word) - z + 1) * pow(z, -bare) AS score FROM r)
SELECT word, bare, dotted, round(score, 6) AS score FROM s WHERE score >= 1e-5
"""
CASE_NAMES = rf"""
WITH p AS (SELECT unnest({_PIECES}) AS p FROM documents),
w AS (SELECT regexp_extract_all(p, '\p{{L}}[\p{{L}}''-]*') AS w FROM p),
e AS (SELECT unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
c AS (SELECT lower(x) AS word, sum((regexp_matches(x, '^\p{{Lu}}') AND i > 1)::INT)::BIGINT AS capital, sum((NOT regexp_matches(x, '^\p{{Lu}}'))::INT)::BIGINT AS small FROM e GROUP BY 1)
SELECT * FROM c WHERE capital >= 3 AND capital >= 0.5 * (capital + small)
"""
_TERMS = f"""
ts AS (SELECT doc_id, unnest({_PIECES}) AS p, generate_subscripts({_PIECES}, 1) AS si FROM documents),
tw AS (SELECT doc_id, si, {_words('lower(p)')} AS w FROM ts),
tg AS (SELECT doc_id, si, n, j, array_to_string(w[j:j + n - 1], ' ') AS term FROM tw, (VALUES (2), (3), (4)) AS l(n), unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(j)
       WHERE length(w[j]) >= 3 AND length(w[j + n - 1]) >= 3 AND w[j] NOT IN ({_STOP}) AND w[j + n - 1] NOT IN ({_STOP})),
tf AS (SELECT term, n, count(*) AS f, count(DISTINCT doc_id) AS df FROM tg GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
th AS (SELECT a.term, count(*) AS holders, sum(b.f) AS held FROM tf b, unnest(list_distinct(flatten(list_transform(range(2, b.n), lambda m: list_transform(range(1, b.n - m + 2), lambda j: array_to_string(string_split(b.term, ' ')[j:j + m - 1], ' ')))))) AS i(x) JOIN tf a ON a.term = i.x GROUP BY ALL),
wc AS (SELECT word, count(*) AS f FROM (SELECT unnest({_words('lower(text)')}) AS word FROM documents) GROUP BY ALL),
tl AS (SELECT term, sum(ln(wc.f)) AS logs FROM (SELECT term, unnest(string_split(term, ' ')) AS word FROM tf) JOIN wc USING (word) GROUP BY ALL),
tt AS (SELECT term, n, f, df, coalesce(holders, 0) AS holders, log2(n) * (f - coalesce(held / holders, 0)) AS cvalue,
              (ln(f) + (n - 1) * ln((SELECT sum(f) FROM wc)) - logs) / greatest(-(n - 1) * ln(f / (SELECT sum(f) FROM wc)::DOUBLE), 1e-12) AS association
       FROM tf LEFT JOIN th USING (term) JOIN tl USING (term))
"""
CONCEPT_TERMS = f"WITH {_TERMS} SELECT term, n, f, df, holders, round(cvalue, 6) AS cvalue, round(association, 6) AS association FROM tt"
DOCUMENT_CONCEPTS = f"""WITH {_TERMS},
td AS (SELECT doc_id, term, count(*) AS count, min([si, j, -n]) AS first FROM tg WHERE term IN (SELECT term FROM tt WHERE cvalue > 3 AND association > 0.1) GROUP BY ALL)
SELECT doc_id, term, count, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, first)::INT AS rank FROM td QUALIFY rank <= 8"""

_LEMMAS = f"""
lw AS (SELECT doc_id, list_filter({_words('lower(text)')}, lambda x: regexp_full_match(x, '\\p{{L}}+')) AS a FROM documents),
lv AS (SELECT word FROM (SELECT doc_id, unnest(list_distinct(a)) AS word FROM lw) GROUP BY word HAVING count(*) >= 3),
lp AS (SELECT word, word[1:i] AS stem, word[i + 1:] AS ending FROM lv, unnest(range(greatest(4, length(word) - 4), length(word) + 1)) AS u(i)),
lm AS (SELECT a.word, a.ending AS longer, b.word AS lemma, b.ending AS shorter FROM lp a JOIN lp b ON a.stem = b.stem WHERE length(a.ending) > length(b.ending)),
lr AS (SELECT longer, shorter, count(*) AS support FROM lm GROUP BY ALL HAVING count(*) >= 20),
lt AS (SELECT word, lemma, support FROM lm JOIN lr USING (longer, shorter) QUALIFY row_number() OVER (PARTITION BY word ORDER BY support DESC, length(lemma), lemma) = 1)
"""
LEMMAS = f"WITH {_LEMMAS} SELECT * FROM lt"
COMPLEXITY_LEMMAS = f"""WITH {_STATS}, {_LEMMAS},
ln AS (SELECT doc_id, count(DISTINCT coalesce(lemma, word)) AS lemmas FROM (SELECT doc_id, unnest(list_distinct(a)) AS word FROM lw) LEFT JOIN lt USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(lemmas, 0) AS lemmas, CASE WHEN ok THEN round_even(CASE WHEN len(a) > 0 THEN coalesce(lemmas, 0)::DOUBLE / len(a) ELSE 0.0 END * 100 + s / k * 0.5, 2) ELSE 0.0 END AS complexity
FROM full_docs JOIN lw USING (doc_id) LEFT JOIN ln USING (doc_id)"""

ORACLE_SQL = {
    "induced_lexicon": INDUCED_LEXICON, "induced_sentiment": INDUCED_SENTIMENT,
    "lemma_pairs": LEMMAS, "complexity_by_lemmas": COMPLEXITY_LEMMAS,
    "word_pairs": WORD_PAIRS, "abbreviation_scores": ABBREVIATIONS, "case_names": CASE_NAMES, "concept_terms": CONCEPT_TERMS, "document_concepts": DOCUMENT_CONCEPTS,
    "graph_store_merge": UPSERT, "indexed_neighbors": INDEXED, "lexicon_hits": LEXICON_HITS, "lexicon_documents": LEXICON_DOCS, "knn_parts": KNN_PARTS,
    "knn_centroids": CENTROIDS, "graph_schema": GRAPH_SCHEMA, "merged_nodes": NODES, "episode_rows": EPISODES, "nlp_guests": GUESTS,
    "sampled_phrases": SAMPLED, "bronze_rows": BRONZE, "audit_lines": AUDIT_LINES, "audit_summary": AUDIT_SUMMARY, "bare_replies": REPLIES,
    "exports": EXPORTS,
    "sentence_stats": SENTENCE_STATS, "chaos_score": CHAOS, "high_chaos_topk": CHAOS_TOP, "complexity_score": COMPLEXITY,
    "sentiment": SENTIMENT, "phrase_hits": PHRASE_HITS, "business_start": BUSINESS, "top_concepts": TOP_CONCEPTS,
    "ngram_doc_freq": NGRAMS, "toxic_phrases": TOXIC, "ad_sentence_rules": AD_RULES, "clean_text_digest": CLEAN,
    "silver_summary": SUMMARY, "chunk_bounds": CHUNK_BOUNDS, "chunk_features": CHUNK_FEATURES, "host_corpus": HOST,
    "visual_corpus": VISUAL, "valid_concepts": CONCEPT_ROWS, "graph_nodes": NODES, "edges_discussed": DISCUSSED,
    "edges_cooccur": COOCCUR, "edge_upsert": UPSERT, "topic_authority": AUTHORITY, "chaos_edges": CHAOS_EDGES,
    "entity_neighbors": NEIGHBOURS, "shortest_connection": SHORTEST, "vector_norms": NORMS, "knn_topk": KNN,
    "knn_label_agreement": AGREEMENT, "history_window": HISTORY, "steps_report": STEPS, "latency_report": LATENCY,
    "trace_report": TRACES, "token_count": TOKENS, "filename_metadata": FILES, "raw_audit": AUDIT,
    "hybrid_retrieval": HYBRID, "preview": PREVIEW, "events_by_day": BY_DAY,
}
