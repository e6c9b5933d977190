"""SQL that states the results of the queries in ``reference`` on the same tables."""

from __future__ import annotations

from tidewrack.functions.text import STOP_WORDS
from tidewrack.plans.reference import CUT, QUESTION, TERMS

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _key(c: str) -> str:
    return f"nullif(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13))), '')"


def _tokens(c: str) -> str:
    masked = rf"regexp_replace(lower(coalesce({c}, '')), '[^\P{{L}}a-z]|[^\P{{N}}0-9]|\p{{M}}', '_', 'g')"
    return rf"list_filter(regexp_extract_all({masked}, '\b[a-z0-9][a-z0-9''-]*\b'), lambda x: NOT list_contains({_STOP}, x))"


def _aliases(c: str) -> str:
    masked = rf"regexp_replace(coalesce({c}, ''), '[^\P{{L}}A-Za-z]|[^\P{{N}}0-9]|\p{{M}}', '_', 'g')"
    found = rf"regexp_extract_all({masked}, '[A-Za-z]{{2,4}}-\d+|PR\s*#?\d+|\b[a-z]{{1,4}}\d+\b|\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b')"
    return f"list_sort(list_distinct(list_transform({found}, lambda a: lower(a))))"


def _squeezed(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


_READINGS = """
    raw AS (
        SELECT 'user ' || user_id AS topic, CASE event_type WHEN 'error' THEN 'blocked' WHEN 'signup' THEN 'at_risk' WHEN 'purchase' THEN 'on_track' ELSE 'unclear' END AS status,
               CASE WHEN value >= 80 THEN 'high' WHEN value >= 20 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN event_id % 3 <> 0 THEN 'owner ' || (event_id % 7) END AS owner,
               CASE WHEN event_type = 'error' OR event_id % 11 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'part ' || (event_id % 5) || ' is missing' ELSE 'budget ' || (event_id % 5) || ' was cut' END END AS blocker, CAST(date_trunc('day', ts) AS TIMESTAMP) AS seen_at, event_id AS seq,
               CASE WHEN event_id % 2 = 0 THEN 'slack' ELSE 'email' END AS source FROM events),
    readings AS (
        SELECT *, i AS importance, date_diff('day', DATE '1970-01-01', CAST(seen_at AS DATE)) * 100 + i AS state_rank, (i // 10) * 10 + CASE WHEN confidence = 'high' THEN 1 ELSE 0 END AS coarse
        FROM (SELECT *, CASE status WHEN 'blocked' THEN 30 WHEN 'at_risk' THEN 20 WHEN 'unclear' THEN 10 ELSE 0 END + CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS i FROM raw))
"""


def _state(name: str = "state", where: str = "true") -> str:
    return f"""
    {name}_r AS (SELECT *, coalesce(state_rank > max(state_rank) OVER (PARTITION BY topic ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_record,
                        row_number() OVER (PARTITION BY topic ORDER BY state_rank DESC, seq) AS place FROM readings WHERE {where}),
    {name} AS (
        SELECT topic, max(status) FILTER (place = 1) AS status, max(confidence) FILTER (place = 1) AS confidence, max(blocker) FILTER (place = 1) AS blocker, arg_max(owner, seq) FILTER (is_record AND owner IS NOT NULL) AS owner,
               count(*) AS mentions, arg_min(seen_at, seq) AS first_seen, max(seen_at) AS last_seen, count(*) FILTER (is_record) - 1 AS updates FROM {name}_r GROUP BY topic)
"""


def _merged(rank: str) -> str:
    return f"""
    WITH {_READINGS}, r AS (SELECT *, coalesce({rank} > max({rank}) OVER (PARTITION BY topic ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_record,
                                   row_number() OVER (PARTITION BY topic ORDER BY {rank} DESC, seq) AS place FROM readings)
    SELECT topic, max(status) FILTER (place = 1) AS status, max(confidence) FILTER (place = 1) AS confidence,
           coalesce(arg_max(owner, seq) FILTER (is_record AND owner IS NOT NULL), arg_min(owner, seq) FILTER (owner IS NOT NULL)) AS owner,
           coalesce(arg_max(blocker, seq) FILTER (is_record AND blocker IS NOT NULL), arg_min(blocker, seq) FILTER (blocker IS NOT NULL)) AS blocker, count(*) AS readings FROM r GROUP BY topic
    """


_URGENCY = "CASE status WHEN 'blocked' THEN 3 WHEN 'at_risk' THEN 2 WHEN 'unclear' THEN 1 WHEN 'on_track' THEN 0 ELSE -1 END"
_SURE = "CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END"

_ARTIFACTS = f"""
    artifacts AS (
        SELECT {_key('artifact_id')} AS artifact_id, source, {_key('container_id')} AS container_id, {_key('parent_id')} AS parent_id, upper({_key('sender_id')}) AS sender_id,
               list_transform(recipients, lambda r: upper({_key('r')})) AS recipients, CASE WHEN regexp_matches(ts, '^\\s*\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(ts AS TIMESTAMPTZ) END AS ts, text
        FROM (SELECT * FROM email UNION ALL BY NAME SELECT * FROM ticket) WHERE {_key('artifact_id')} IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY {_key('artifact_id')} ORDER BY loaded_at, source) = 1)
"""
_EVIDENCE = "evidence AS (SELECT * FROM topic_evidence WHERE evidence_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY loaded_at) = 1)"
_TERMS = "['blocked', 'retry', 'logic', 'schema', 'migration', 'svc-payout']"


def _bm25(source: str, id_column: str) -> str:
    return f"""
    toks AS (SELECT {id_column} AS id, {_tokens('text')} AS t FROM {source}),
    tf AS (SELECT id, len(t) AS length, q, len(list_filter(t, lambda w: w = q)) AS tf FROM toks, (SELECT unnest({_TERMS}) AS q)),
    df AS (SELECT q, count(*) FILTER (tf > 0) AS df, (SELECT count(*) FROM toks) AS n, (SELECT sum(len(t)) / count(*) FROM toks) AS average FROM tf GROUP BY q),
    ranked AS (
        SELECT id, round(sum(greatest(0.0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / average))), 6) AS score
        FROM tf JOIN df USING (q) GROUP BY id HAVING max(tf) > 0)
"""


_SCORE = " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN 1 ELSE 0 END" for t in TERMS)
_COSINE = "round(list_dot_product(q.v, r.v) / (greatest(sqrt(list_dot_product(q.v, q.v)), 1e-9) * greatest(sqrt(list_dot_product(r.v, r.v)), 1e-9)), 6)"
_VECTORS = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)"

_ENTITIES = f"""
    terms AS (
        SELECT upper({_key('employee_id')}) AS entity, unnest(list_concat(list_concat(coalesce(aliases, []), [name]), [email, slack_handle])) AS term FROM employees WHERE employee_id IS NOT NULL
        UNION ALL SELECT upper({_key('entity_id')}), name FROM externals WHERE entity_id IS NOT NULL),
    known AS (SELECT entity, unnest({_tokens('term')}) AS token FROM terms UNION SELECT entity, lower(entity) FROM terms),
    mined AS (SELECT artifact_id, unnest({_aliases('text')}) AS token FROM artifacts),
    runs AS (SELECT artifact_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+(?:[''-]+[\\p{{L}}\\p{{N}}\\p{{M}}_]+)*'))) AS run FROM artifacts),
    words AS (SELECT artifact_id, regexp_extract_all(run, '[''-]*[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS w FROM runs),
    said AS (
        SELECT artifact_id, unnest(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(i, len(w) + 1), lambda j: ltrim(array_to_string(w[i:j], ''), '''-'))))) AS token FROM words
        UNION SELECT * FROM mined UNION SELECT artifact_id, unnest({_tokens('container_id')}) FROM artifacts UNION SELECT artifact_id, coalesce(container_id, '') FROM artifacts),
    links AS (
        SELECT artifact_id, upper(trim(entity)) AS entity FROM said JOIN known USING (token) UNION SELECT artifact_id, upper(trim(token)) FROM mined WHERE token NOT IN (SELECT token FROM known WHERE token IS NOT NULL)
        UNION SELECT artifact_id, sender_id FROM artifacts WHERE sender_id IS NOT NULL UNION SELECT artifact_id, r FROM (SELECT artifact_id, unnest(recipients) AS r FROM artifacts) WHERE r IS NOT NULL)
"""
_PARTS = """
    one AS (SELECT id, payload.mimeType AS mime, payload.body.data AS data, 0 AS i, 0 AS j, snippet, internalDate, payload FROM gmail_raw),
    two AS (SELECT id, unnest(payload.parts) AS p, generate_subscripts(payload.parts, 1) AS i, payload FROM gmail_raw),
    three AS (SELECT id, unnest(p.parts) AS p, i, generate_subscripts(p.parts, 1) AS j, payload FROM two),
    parts AS (
        SELECT id, payload, mime, data, i, j FROM one UNION ALL SELECT id, payload, p.mimeType, p.body.data, i, 0 FROM two UNION ALL SELECT id, payload, p.mimeType, p.body.data, i, j FROM three),
    decoded AS (SELECT *, decode(from_base64(rpad(translate(data, '-_', '+/'), CAST(ceil(len(data) / 4.0) * 4 AS INTEGER), '='))) AS text FROM parts WHERE coalesce(data, '') <> '')
"""
_DETAGGED = "regexp_replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&mdash;', '—'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t]+', ' ', 'g')"

ORACLE = {
    "topic_state": f"WITH {_READINGS}, {_state()} SELECT * FROM state",
    "ranked_blocked_topics": f"WITH {_READINGS}, {_state()} SELECT topic, {_URGENCY} AS urgency, last_seen, mentions FROM state WHERE status = 'blocked' ORDER BY 2 DESC, 3 DESC, 4 DESC, 1 LIMIT 12",
    "briefing_top12": f"WITH {_READINGS}, {_state()} SELECT topic, status, confidence, owner, blocker FROM state ORDER BY {_URGENCY} DESC, {_SURE} DESC, topic LIMIT 12",
    "briefing_tail": f"WITH {_READINGS}, {_state()} SELECT status, count(*) AS n FROM (SELECT status FROM state ORDER BY {_URGENCY} DESC, {_SURE} DESC, topic OFFSET 12) GROUP BY 1",
    "topic_status_counts": f"WITH {_READINGS}, {_state()} SELECT status, count(*) AS n FROM state GROUP BY 1",
    "store_stats": f"WITH {_READINGS}, {_state()} SELECT count(*) AS topics, CAST(sum(mentions) AS BIGINT) AS readings, CAST(sum(updates) AS BIGINT) AS updates, count(owner) AS owned FROM state",
    "topic_history_last6": f"WITH {_READINGS} SELECT topic, seq, status, confidence, CAST(row_number() OVER w AS INTEGER) AS place FROM readings WINDOW w AS (PARTITION BY topic ORDER BY seen_at DESC, seq DESC) QUALIFY row_number() OVER w <= 6",
    "merged_items": _merged("importance"),
    "deduped_items": _merged("coarse"),
    "message_ids": "SELECT left(sha256(coalesce(source, 'None') || '|' || coalesce(sender, 'None') || '|' || coalesce(timestamp, 'None') || '|' || coalesce(text, 'None')), 16) AS message_id, count(*) AS n FROM messages GROUP BY 1",
    "new_messages": f"""
        SELECT id, source, ingested_at FROM messages m WHERE id IS NOT NULL AND NOT (ingested_at < TIMESTAMP '{CUT}') AND id NOT IN (SELECT id FROM messages WHERE ingested_at < TIMESTAMP '{CUT}' AND id IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at, source) = 1
    """,
    "evidence_verified": f"""
        WITH {_ARTIFACTS}, e AS (SELECT evidence_id, {_squeezed('span')} AS span, {_key('artifact_id')} AS id FROM topic_evidence)
        SELECT evidence_id, CASE WHEN coalesce(span, '') = '' THEN 'empty' WHEN a.artifact_id IS NULL THEN 'no_artifact' WHEN contains({_squeezed('text')}, span) THEN 'verified' ELSE 'not_in_text' END AS verdict, count(*) AS n
        FROM e LEFT JOIN artifacts a ON a.artifact_id = e.id GROUP BY 1, 2
    """,
    "topics_without_evidence": f"""
        WITH {_ARTIFACTS} SELECT topic_key, count(*) AS pieces FROM topic_evidence e LEFT JOIN artifacts a ON a.artifact_id = {_key('e.artifact_id')}
        GROUP BY 1 HAVING count(*) FILTER (coalesce(span, '') <> '' AND contains({_squeezed('a.text')}, {_squeezed('span')})) = 0
    """,
    "evidence_top6": f"""
        WITH {_ARTIFACTS}, {_EVIDENCE}, x AS (SELECT e.topic_key, e.evidence_id, {_key('e.artifact_id')} AS artifact_id, CAST(floor(epoch(a.ts)) AS BIGINT) AS ts FROM evidence e LEFT JOIN artifacts a ON a.artifact_id = {_key('e.artifact_id')})
        SELECT *, CAST(row_number() OVER w AS INTEGER) AS place FROM x WINDOW w AS (PARTITION BY topic_key ORDER BY ts DESC NULLS LAST, artifact_id NULLS FIRST, evidence_id) QUALIFY row_number() OVER w <= 6
    """,
    "evidence_union": f"""
        WITH {_EVIDENCE} SELECT topic_key, {_key('artifact_id')} AS artifact_id, span, evidence_id FROM evidence
        QUALIFY row_number() OVER (PARTITION BY topic_key, {_key('artifact_id')}, {_squeezed('span')} ORDER BY evidence_id) = 1
    """,
    "topic_keys": f"""
        WITH w AS (SELECT topic_key AS k, list_filter(regexp_split_to_array(regexp_replace(lower(topic_key), '[^a-z0-9 ]+', ' ', 'g'), ' +'), lambda x: x <> '') AS ws FROM topic_evidence),
        s AS (SELECT k, array_to_string(list_sort(list_filter(ws, lambda x: x NOT IN ('the', 'a', 'an', 'project', 'team', 'workstream', 'initiative'))), ' ') AS a, array_to_string(list_sort(list_filter(ws, lambda x: x NOT IN ('the', 'a', 'an', 'project', 'team'))), ' ') AS b FROM w)
        SELECT CASE WHEN a <> '' THEN a ELSE trim(lower(k)) END AS store_key, CASE WHEN b <> '' THEN b ELSE trim(lower(k)) END AS merge_key, {_squeezed('lower(k)')} AS subject_key, count(*) AS n FROM s GROUP BY 1, 2, 3
    """,
    "doc_stats": f"SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "doc_freq": f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({_tokens('text')})) AS token FROM documents) GROUP BY 1",
    "bm25_topk": f"WITH {_bm25('documents', 'doc_id')} SELECT id AS doc_id, score FROM ranked ORDER BY score DESC, id LIMIT 15",
    "keyword_search": f"SELECT doc_id, ({_SCORE}) / {float(len(TERMS))} AS score FROM documents WHERE ({_SCORE}) > 0 ORDER BY score DESC, doc_id LIMIT 20",
    "cosine_topk": f"""
        WITH {_VECTORS} SELECT q.vec_id AS query_id, r.vec_id AS id, {_COSINE} AS score FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0
        QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, r.vec_id) <= 8
    """,
    "context_union": f"""
        WITH {_READINGS}, {_state()}, {_VECTORS}, near AS (SELECT 'user ' || r.vec_id AS topic FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id = 0 ORDER BY {_COSINE} DESC, r.vec_id LIMIT 8),
        hits AS (SELECT topic FROM near WHERE topic IN (SELECT topic FROM state)),
        urgent AS (SELECT topic FROM (SELECT topic, {_URGENCY} AS u FROM state ORDER BY u DESC, last_seen DESC, mentions DESC, topic LIMIT 5) WHERE u >= 2)
        SELECT topic, 'semantic' AS why FROM hits UNION ALL SELECT topic, 'urgent' FROM urgent WHERE topic NOT IN (SELECT topic FROM hits)
    """,
    "stale_embeddings": f"""
        WITH {_READINGS}, {_state()}, {_state('earlier', "seen_at < TIMESTAMP '2024-01-20'")}
        SELECT s.topic, concat_ws('. ', s.topic, s.status, s.owner, s.blocker) AS text FROM state s LEFT JOIN earlier e ON e.topic = s.topic
        WHERE concat_ws('. ', s.topic, s.status, s.owner, s.blocker) IS DISTINCT FROM CASE WHEN e.topic IS NOT NULL THEN concat_ws('. ', e.topic, e.status, e.owner, e.blocker) END
    """,
    "alias_keys": f"SELECT alias, count(*) AS n FROM (SELECT unnest({_aliases('text')}) AS alias FROM (SELECT text FROM email UNION ALL SELECT text FROM ticket)) GROUP BY 1",
    "alias_matches": f"""
        WITH {_ARTIFACTS}, terms AS (
            SELECT upper({_key('employee_id')}) AS entity, unnest(list_concat(list_concat(coalesce(aliases, []), [name]), [email, slack_handle])) AS term FROM employees WHERE employee_id IS NOT NULL
            UNION ALL SELECT upper({_key('entity_id')}), name FROM externals WHERE entity_id IS NOT NULL),
        known AS (SELECT entity, unnest({_tokens('term')}) AS token FROM terms UNION SELECT entity, lower(entity) FROM terms),
        words AS (SELECT artifact_id, unnest(list_distinct({_tokens('text')})) AS token FROM artifacts)
        SELECT entity, count(DISTINCT artifact_id) AS n FROM words JOIN known USING (token) GROUP BY 1
    """,
    "source_ablation": f"""
        WITH {_ARTIFACTS}, {_bm25('artifacts', 'artifact_id')}, top AS (SELECT id FROM ranked ORDER BY score DESC, id LIMIT 20)
        SELECT id AS artifact_id, a.source AS only FROM top JOIN artifacts a ON a.artifact_id = top.id WHERE a.source IN ('email', 'ticket')
    """,
    "thread_neighbours": f"WITH {_ARTIFACTS} SELECT f.artifact_id AS from_id, count(*) AS n FROM artifacts f JOIN artifacts o ON o.container_id = f.container_id AND o.artifact_id <> f.artifact_id WHERE f.parent_id IS NULL GROUP BY 1",
    "time_neighbours": f"""
        WITH {_ARTIFACTS}, {_bm25('artifacts', 'artifact_id')}, top AS (SELECT id FROM ranked ORDER BY score DESC, id LIMIT 20)
        SELECT DISTINCT f.artifact_id AS from_id, o.artifact_id FROM top JOIN artifacts f ON f.artifact_id = top.id
        JOIN artifacts o ON o.sender_id = f.sender_id AND o.source = f.source AND o.artifact_id <> f.artifact_id AND abs(epoch(o.ts) - epoch(f.ts)) <= 21600
    """,
    "conflicting_claims": f"""
        WITH {_READINGS}, c AS (SELECT topic AS subject, {_squeezed('lower(blocker)')} AS claim, seq, source, status, confidence FROM readings WHERE blocker IS NOT NULL QUALIFY row_number() OVER (PARTITION BY topic, lower(blocker) ORDER BY seq) = 1)
        SELECT a.subject, a.seq AS seq_a, b.seq AS seq_b, a.claim AS claim_a, b.claim AS claim_b,
               CASE WHEN (b.confidence = 'high' AND a.confidence <> 'high') OR (a.source = b.source AND a.status = 'blocked' AND b.status <> 'blocked') THEN b.seq ELSE a.seq END AS winner
        FROM c a JOIN c b ON a.subject = b.subject AND a.seq < b.seq AND a.claim <> b.claim
        WHERE len(list_intersect(string_split(a.claim, ' '), string_split(b.claim, ' '))) / greatest(len(list_distinct(string_split(a.claim, ' '))), len(list_distinct(string_split(b.claim, ' ')))) <= 0.7
    """,
    "owner_referral": f"""
        WITH {_ARTIFACTS}, e AS (SELECT upper({_key('employee_id')}) AS id, name, upper({_key('manager_id')}) AS boss FROM employees WHERE employee_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY upper({_key('employee_id')}) ORDER BY loaded_at, name) = 1)
        SELECT e.id AS employee_id, s.tickets, coalesce(b.name, e.name) AS refer_to
        FROM (SELECT sender_id, count(*) AS tickets FROM artifacts WHERE source = 'ticket' AND parent_id IS NULL AND sender_id IS NOT NULL GROUP BY 1) s JOIN e ON e.id = s.sender_id LEFT JOIN e b ON b.id = e.boss
    """,
    "recall_at_k": f"""
        WITH {_bm25('documents', 'doc_id')}, gold AS (SELECT DISTINCT doc_id FROM subject_labels WHERE subject = 'software'), top AS (SELECT id FROM ranked ORDER BY score DESC, id LIMIT 50)
        SELECT (SELECT count(*) FROM gold WHERE doc_id IN (SELECT id FROM top)) AS found, (SELECT count(*) FROM gold) AS gold, round((SELECT count(*) FROM gold WHERE doc_id IN (SELECT id FROM top)) / (SELECT count(*) FROM gold), 6) AS recall
    """,
    "fabricated_citations": f"""
        WITH {_ARTIFACTS}, {_EVIDENCE} SELECT evidence_id, 3 AS cited, CASE WHEN a.artifact_id IS NULL THEN {_key('e.artifact_id')} || ',eml_none,chk-1' ELSE 'eml_none,chk-1' END AS fabricated
        FROM evidence e LEFT JOIN artifacts a ON a.artifact_id = {_key('e.artifact_id')} WHERE {_key('e.artifact_id')} IS NOT NULL
    """,
    "html_bodies": """
        SELECT DISTINCT id, regexp_replace(replace(replace(replace(regexp_replace('<p>' || snippet || '</p> &amp;' || chr(9) || '<b>x</b>&nbsp;&mdash;', '<[^>]+>', ' ', 'g'), '&mdash;', '—'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t]+', ' ', 'g') AS text FROM gmail_raw
    """,
    "html_parts": f"WITH {_PARTS} SELECT DISTINCT id, {_DETAGGED} AS text FROM decoded WHERE mime = 'text/html'",
    "entity_links": f"WITH {_ARTIFACTS}, {_ENTITIES} SELECT entity, count(*) AS n FROM links GROUP BY 1",
    "retrieval_seeds": f"""
        WITH {_ARTIFACTS}, {_ENTITIES}, {_bm25('artifacts', 'artifact_id')}, q AS (SELECT unnest(list_concat({_tokens(f"'{QUESTION}'")}, {_aliases(f"'{QUESTION}'")})) AS token),
        hits AS (
            SELECT DISTINCT artifact_id FROM links WHERE entity IN (SELECT upper(trim(entity)) FROM known JOIN q USING (token))
            UNION SELECT artifact_id FROM artifacts WHERE list_has_any(list_concat(list_concat({_aliases('text')}, list_concat({_aliases('container_id')}, {_aliases('parent_id')})), list_concat({_tokens('container_id')}, {_tokens('parent_id')})), {_aliases(f"'{QUESTION}'")})),
        turns AS (
            SELECT id AS artifact_id, 0 AS list, row_number() OVER (ORDER BY score DESC, id) AS turn FROM (SELECT * FROM ranked ORDER BY score DESC, id LIMIT 60)
            UNION ALL SELECT artifact_id, 1, row_number() OVER (ORDER BY artifact_id) FROM (SELECT * FROM hits ORDER BY artifact_id LIMIT 40)),
        firsts AS (SELECT artifact_id, min(turn * 2 + list) AS spot FROM turns GROUP BY 1)
        SELECT artifact_id, CAST(row_number() OVER (ORDER BY spot, artifact_id) AS INTEGER) AS place FROM firsts ORDER BY spot, artifact_id LIMIT 40
    """,
    "artifact_validation": """
        SELECT CASE WHEN trim(coalesce(artifact_id, '')) = '' THEN 'artifact_id' WHEN trim(coalesce(source, '')) = '' THEN 'source' WHEN trim(coalesce(container_id, '')) = '' THEN 'container_id' WHEN trim(coalesce(sender_id, '')) = '' THEN 'sender_id'
                    WHEN ts IS NULL THEN 'ts' WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'text' ELSE 'ok' END AS reason, count(*) AS n FROM (SELECT * FROM email UNION ALL BY NAME SELECT * FROM ticket) GROUP BY 1
    """,
    "json_props": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "chunks": f"WITH {_ARTIFACTS} SELECT artifact_id, CAST((row_number() OVER (ORDER BY artifact_id) - 1) // 40 AS BIGINT) AS chunk FROM artifacts WHERE source = 'ticket' AND container_id IS NOT NULL",
    "all_chunks": f"WITH {_ARTIFACTS} SELECT artifact_id, CAST((row_number() OVER (ORDER BY artifact_id) - 1) // 40 AS BIGINT) AS chunk FROM artifacts",
    "last_turns": f"""
        WITH {_ARTIFACTS} SELECT container_id, artifact_id, CAST(row_number() OVER w AS INTEGER) AS place FROM artifacts WHERE container_id IS NOT NULL
        WINDOW w AS (PARTITION BY container_id ORDER BY epoch(ts) DESC NULLS LAST, artifact_id DESC) QUALIFY row_number() OVER w <= 8
    """,
    "request_rate": """
        SELECT user_id, max(n) AS peak FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1
    """,
    "dangling_parents": f"WITH {_ARTIFACTS} SELECT artifact_id, parent_id FROM artifacts WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT artifact_id FROM artifacts)",
    "unknown_senders": f"""
        WITH {_ARTIFACTS}, people AS (SELECT upper({_key('employee_id')}) AS id FROM employees UNION SELECT upper({_key('entity_id')}) FROM externals)
        SELECT sender_id, count(*) AS n FROM artifacts WHERE sender_id IS NOT NULL AND sender_id NOT IN (SELECT id FROM people WHERE id IS NOT NULL) GROUP BY 1
    """,
    "fact_partition": f"""
        WITH {_ARTIFACTS}, f AS (SELECT coalesce(container_id, '-') AS container_id, unnest({_aliases('text')}) AS fact FROM artifacts)
        SELECT container_id, count(DISTINCT fact) AS facts, count(DISTINCT fact) >= (SELECT count(DISTINCT fact) FROM f) AS enough FROM f GROUP BY 1
    """,
    "silence_pairs": f"""
        WITH {_ARTIFACTS} SELECT f.artifact_id, f.container_id FROM artifacts f WHERE source = 'email' AND parent_id IS NULL AND ts IS NOT NULL AND container_id IS NOT NULL AND sender_id IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM artifacts r WHERE r.source = 'email' AND r.container_id = f.container_id AND r.sender_id <> f.sender_id AND epoch(r.ts) - epoch(f.ts) BETWEEN 0 AND 172800)
    """,
    "channel_outsiders": f"""
        WITH {_ARTIFACTS}, mails AS (SELECT * FROM artifacts WHERE source = 'email' AND container_id IS NOT NULL),
        members AS (SELECT container_id, unnest(recipients) AS id FROM mails WHERE parent_id IS NULL UNION SELECT container_id, sender_id FROM mails WHERE parent_id IS NULL)
        SELECT container_id, sender_id, count(*) AS n FROM mails m WHERE parent_id IS NOT NULL AND sender_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM members x WHERE x.container_id = m.container_id AND x.id = m.sender_id) GROUP BY 1, 2
    """,
    "answer_terms": f"""
        WITH {_READINGS}, {_state()}, h AS (SELECT *, lower(topic || ' ' || coalesce(blocker, 'none') || ' ' || coalesce(owner, 'none')) AS hay FROM state WHERE confidence IN ('high', 'medium')),
        k AS (SELECT *, CASE WHEN contains(hay, 'user') THEN 1 ELSE 0 END + CASE WHEN contains(hay, 'part') THEN 1 ELSE 0 END + CASE WHEN contains(hay, 'owner') THEN 1 ELSE 0 END AS hits FROM h)
        SELECT topic, status, confidence, hits FROM k WHERE hits > 0 ORDER BY {_SURE} DESC, CASE status WHEN 'blocked' THEN 3 WHEN 'at_risk' THEN 2 WHEN 'on_track' THEN 1 WHEN 'unclear' THEN 0 ELSE -1 END DESC, topic LIMIT 24
    """,
    "ingest_stats": """
        WITH w AS (SELECT source, list_filter([CASE WHEN coalesce(trim(sender), '') = '' THEN 'no sender' END, CASE WHEN coalesce(trim(timestamp), '') = '' THEN 'no timestamp' END, CASE WHEN coalesce(trim(text), '') = '' THEN 'no text' END], lambda x: x IS NOT NULL) AS w FROM messages)
        SELECT source, warning, count(*) AS n FROM (SELECT source, unnest(CASE WHEN len(w) > 0 THEN w ELSE ['ok'] END) AS warning FROM w) GROUP BY 1, 2
    """,
    "working_days": f"""
        WITH {_READINGS}, {_state()} SELECT topic, CAST(len(list_filter(generate_series(least(first_seen, last_seen), greatest(first_seen, last_seen), INTERVAL 1 DAY), lambda t: isodow(t) < 6)) AS INTEGER) AS days FROM state
    """,
    "item_sentences": f"""
        WITH {_READINGS}, {_state()} SELECT topic,
            concat_ws(' ', topic, CASE status WHEN 'blocked' THEN 'is blocked' WHEN 'at_risk' THEN 'is at risk' WHEN 'on_track' THEN 'is on track' ELSE 'is unclear' END, 'because ' || nullif(concat_ws('; ', blocker, owner || ' is responsible'), ''), '[ev]') AS sentence,
            '• *' || topic || '*' || coalesce(' — ' || blocker, '') || coalesce(' (' || owner || ')', ' (no owner named)') || CASE WHEN confidence = 'low' THEN ' _[low confidence, needs confirmation]_' ELSE '' END AS line,
            concat_ws('. ', topic, 'status: ' || status, 'owner: ' || owner, 'blocker: ' || blocker) AS embedded FROM state
    """,
    "conflict_sentences": f"""
        WITH {_READINGS}, c AS (SELECT topic AS subject, {_squeezed('lower(blocker)')} AS claim, seq FROM readings WHERE blocker IS NOT NULL QUALIFY row_number() OVER (PARTITION BY topic, lower(blocker) ORDER BY seq) = 1)
        SELECT a.seq AS seq_a, b.seq AS seq_b, 'There is a disagreement about ' || a.subject || ': one report says ' || a.claim || ' [' || a.seq || '], another says ' || b.claim || ' [' || b.seq || ']. The resolution is newer wins: The later claim counts.' AS sentence
        FROM c a JOIN c b ON a.subject = b.subject AND a.seq < b.seq AND a.claim <> b.claim
        WHERE len(list_intersect(string_split(a.claim, ' '), string_split(b.claim, ' '))) / greatest(len(list_distinct(string_split(a.claim, ' '))), len(list_distinct(string_split(b.claim, ' ')))) <= 0.7
    """,
    "prompt_blocks": "SELECT DISTINCT id, md5('[' || id || '] source=' || coalesce(source, '') || ' | sender=' || coalesce(sender, '') || ' | timestamp=' || coalesce(timestamp, '') || chr(10) || coalesce(text, '')) AS block FROM messages WHERE id IS NOT NULL",
    "topic_lookup": f"WITH {_READINGS}, {_state()} SELECT topic, status FROM state WHERE CASE WHEN EXISTS (SELECT 1 FROM state WHERE topic = 'user 7') THEN topic = 'user 7' ELSE contains(topic, 'user 7') END ORDER BY topic LIMIT 3",
    "container_winner": f"""
        WITH {_ARTIFACTS} SELECT container_id, artifact_id AS winner, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM artifacts WHERE container_id IS NOT NULL AND ts IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY container_id ORDER BY ts DESC, CASE WHEN source = 'ticket' THEN 1 ELSE 0 END DESC, artifact_id DESC) = 1
    """,
    "question_overlap": f"SELECT doc_id, len(list_distinct(list_filter({_tokens('text')}, lambda w: list_contains({_TERMS}, w)))) AS shared FROM documents WHERE len(list_filter({_tokens('text')}, lambda w: list_contains({_TERMS}, w))) > 0",
    "stream_new_messages": "SELECT DISTINCT id FROM messages",
    "stream_topic_fold": "SELECT user_id AS topic, arg_max(event_type, epoch(date_trunc('day', ts)) * 10000000 - event_id) AS event_type, count(*) AS mentions FROM events GROUP BY 1",
}
