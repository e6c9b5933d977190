"""SQL that states the results of the queries in ``knowledge``."""

from __future__ import annotations

from tidewrack.plans.knowledge import FIRST_BATCH, FORBIDDEN
from tidewrack.plans.problems import LINES_SQL, ORACLE as PROBLEMS, instants_sql
from tidewrack.plans.reference import QUESTION
from tidewrack.plans.reference_sql import _ARTIFACTS, _EVIDENCE, _READINGS, _SURE, _URGENCY, _aliases, _key, _squeezed, _state, _tokens

_KNOWN = f"""
    terms AS (
        SELECT upper({_key('employee_id')}) AS entity, unnest(list_concat(list_concat(coalesce(aliases, []), [name]), [email, slack_handle])) AS term FROM employees WHERE employee_id IS NOT NULL
        UNION ALL SELECT upper({_key('entity_id')}), name FROM externals WHERE entity_id IS NOT NULL),
    known AS (SELECT entity, unnest({_tokens('term')}) AS token FROM terms UNION SELECT entity, lower(entity) FROM terms)
"""
_TEXT = "concat_ws('. ', topic, 'status: ' || status, 'owner: ' || owner, 'blocker: ' || blocker)"
_FIRST = f"seq <= (SELECT max(event_id) FROM events) * {FIRST_BATCH}"


def _words(c: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def _content(c: str) -> str:
    return f"list_filter(list_distinct({_tokens(c)}), lambda x: len(x) > 2 AND NOT list_contains({_aliases(c)}, x))"


_LINE = "CASE WHEN blocker IS NOT NULL THEN ' — ' || blocker ELSE '' END || CASE WHEN owner IS NOT NULL THEN ' (' || owner || ')' ELSE ' (no owner named)' END || CASE WHEN confidence = 'low' THEN ' _[low confidence, needs confirmation]_' ELSE '' END"
_HEAD = "CASE status WHEN 'blocked' THEN 'Blocked' WHEN 'at_risk' THEN 'At risk' WHEN 'unclear' THEN 'Unclear' ELSE 'On track' END"

# the fields of an object come out by name
_BY_NAME = """CASE WHEN c.type = 'OBJECT' THEN '{' || array_to_string(list_transform(list_sort(json_keys(c.value::JSON)), lambda k: to_json(k) || ':' || CAST(json_extract(c.value::JSON, '$."' || k || '"') AS VARCHAR)), ',') || '}' ELSE coalesce(c.value, 'null') END"""

ORACLE = {
    "stored_topics": f"WITH {_READINGS}, {_state()} SELECT * FROM state",
    "store_batches": f"""
        WITH {_READINGS}, b AS (SELECT topic, CASE WHEN {_FIRST} THEN 0 ELSE 1 END AS batch FROM readings), t AS (SELECT topic, min(batch) AS made, max(batch) AS last FROM b GROUP BY 1)
        SELECT 0 AS batch, count(*) FILTER (made = 0) AS created, 0 AS updated FROM t UNION ALL SELECT 1, count(*) FILTER (made = 1), count(*) FILTER (made = 0 AND last = 1) FROM t
    """,
    "stale_after_batch": f"""
        WITH {_READINGS}, {_state()}, {_state('earlier', _FIRST)}, a AS (SELECT topic, {_TEXT} AS text FROM state), b AS (SELECT topic, {_TEXT} AS before FROM earlier)
        SELECT a.topic, a.text FROM a LEFT JOIN b ON b.topic = a.topic WHERE a.text IS DISTINCT FROM b.before
    """,
    "status_items": f"WITH {_READINGS}, {_state()} SELECT topic, 'sound' AS verdict FROM state",
    "item_verdicts": f"""
        WITH {_READINGS} SELECT CASE seq % 8 WHEN 1 THEN 'missing field' WHEN 2 THEN 'status' WHEN 3 THEN 'confidence' WHEN 4 THEN 'unknown field' WHEN 5 THEN 'topic' WHEN 6 THEN 'evidence' WHEN 7 THEN 'evidence' ELSE 'sound' END AS verdict, count(*) AS n
        FROM readings GROUP BY 1
    """,
    "claim_positions": f"""
        WITH {_READINGS}, c AS (SELECT topic AS subject, {_squeezed('lower(blocker)')} AS claim, min(seq) AS seq FROM readings WHERE blocker IS NOT NULL GROUP BY 1, 2)
        SELECT a.subject, a.claim, a.seq, count(*) AS opposing FROM c a JOIN c b ON a.subject = b.subject AND a.claim <> b.claim
        WHERE len(list_intersect(string_split(a.claim, ' '), string_split(b.claim, ' '))) / greatest(len(list_distinct(string_split(a.claim, ' '))), len(list_distinct(string_split(b.claim, ' ')))) <= 0.7 GROUP BY 1, 2, 3
    """,
    "briefing_text": f"""
        WITH {_READINGS}, {_state()}, o AS (SELECT *, row_number() OVER (ORDER BY {_URGENCY} DESC, {_SURE} DESC, topic) AS place FROM state),
        parts AS (SELECT {_URGENCY} AS u, '*' || {_HEAD} || '*' || chr(10) || string_agg('• *' || topic || '*' || {_LINE}, chr(10) ORDER BY place) AS part FROM o WHERE place <= 12 GROUP BY 1, status),
        rest AS (SELECT {_URGENCY} AS u, count(*) || ' ' || lower({_HEAD}) AS part, count(*) AS n FROM o WHERE place > 12 GROUP BY 1, status)
        SELECT '*Briefing*' || chr(10) || chr(10) || (SELECT string_agg(part, chr(10) || chr(10) ORDER BY u DESC) FROM parts) || coalesce((SELECT chr(10) || chr(10) || '_Plus ' || sum(n)::BIGINT || ' more not detailed above: ' || string_agg(part, ', ' ORDER BY u DESC) || '._' FROM rest), '') AS text
    """,
    "evidence_lists": f"""
        WITH {_ARTIFACTS}, {_EVIDENCE}, x AS (SELECT e.topic_key, e.evidence_id, {_key('e.artifact_id')} AS artifact_id, CAST(floor(epoch(a.ts)) AS BIGINT) AS ts FROM evidence e LEFT JOIN artifacts a ON a.artifact_id = {_key('e.artifact_id')}),
        r AS (SELECT *, row_number() OVER (PARTITION BY topic_key ORDER BY ts DESC NULLS LAST, artifact_id NULLS FIRST, evidence_id) AS place FROM x),
        l AS (SELECT topic_key, string_agg(evidence_id, ' ' ORDER BY place) AS evidence FROM r WHERE place <= 6 GROUP BY 1)
        SELECT t.topic_key, l.evidence FROM (SELECT DISTINCT topic_key FROM topic_evidence) t LEFT JOIN l ON l.topic_key = t.topic_key
    """,
    "topic_aliases": f"WITH {_KNOWN} SELECT DISTINCT topic_key, entity FROM (SELECT topic_key, unnest({_tokens('topic_key')}) AS token FROM topic_evidence) JOIN known USING (token)",
    "alias_phrases": f"""
        WITH {_ARTIFACTS}, {_KNOWN}, p AS (SELECT DISTINCT entity, {_words('term')} AS phrase FROM terms WHERE {_words('term')} <> ''), w AS (SELECT artifact_id, ' ' || {_words('text')} || ' ' AS said FROM artifacts)
        SELECT entity, count(DISTINCT artifact_id) AS n FROM w JOIN p ON contains(said, ' ' || phrase || ' ') GROUP BY 1
    """,
    "artifact_aliases": f"""
        WITH {_ARTIFACTS}, a AS (
            SELECT artifact_id, unnest(list_concat(list_concat(list_concat({_aliases('text')}, {_aliases('container_id')}), list_concat({_aliases('parent_id')}, {_aliases('sender_id')})),
                list_concat(flatten(list_transform(coalesce(recipients, []), lambda r: {_aliases('r')})), list_concat({_tokens('container_id')}, {_tokens('parent_id')})))) AS alias FROM artifacts)
        SELECT alias, count(DISTINCT artifact_id) AS n FROM a GROUP BY 1
    """,
    "posting_blocks": f"""
        SELECT token, CAST(floor(doc_id / 1000) AS BIGINT) AS block, string_agg(doc_id, ' ' ORDER BY doc_id) AS docs FROM (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(list_distinct({_tokens('text')})) AS token FROM documents)) GROUP BY 1, 2
    """,
    "event_cube": "SELECT event_type, strftime(ts, '%Y-%m') AS month, CAST(grouping(event_type, strftime(ts, '%Y-%m')) AS BIGINT) AS level, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY CUBE (event_type, strftime(ts, '%Y-%m'))",
    "topic_quarters": f"WITH {_READINGS}, {_state()} SELECT topic, CAST(ntile(4) OVER (ORDER BY mentions DESC, topic) AS INTEGER) AS quarter, row_number() OVER (ORDER BY mentions DESC, topic) AS rank FROM state",
    "status_turns": f"WITH {_READINGS}, x AS (SELECT topic, status, lag(status) OVER (PARTITION BY topic ORDER BY seq) AS previous_status FROM readings) SELECT topic, previous_status, status, count(*) AS n FROM x WHERE status <> previous_status GROUP BY 1, 2, 3",
    "last_view_before": """
        WITH v AS (SELECT user_id, ts, arg_max(value, event_id) AS viewed FROM events WHERE event_type = 'view' GROUP BY 1, 2)
        SELECT b.event_id, v.ts AS viewed_at, v.viewed FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN v ON v.user_id = b.user_id AND v.ts <= b.ts
    """,
    "daily_balance": f"WITH {_ARTIFACTS} SELECT strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) FILTER (source = 'email') AS mails, count(*) FILTER (source = 'ticket') AS tickets FROM artifacts WHERE ts IS NOT NULL AND source IN ('email', 'ticket') GROUP BY 1",
    "chunk_usage": f"WITH {_ARTIFACTS}, x AS (SELECT (row_number() OVER (ORDER BY artifact_id) - 1) // 40 AS chunk, length(coalesce(text, '')) AS chars FROM artifacts) SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS artifacts, CAST(sum(chars) AS BIGINT) AS chars FROM x GROUP BY 1",
    "corpus_order": f"WITH {_ARTIFACTS} SELECT artifact_id, row_number() OVER (ORDER BY CAST(floor(epoch(ts)) AS BIGINT) NULLS LAST, artifact_id) AS place FROM artifacts",
    "message_positions": "SELECT id, ingested_at, 'msg_' || row_number() OVER (PARTITION BY source ORDER BY ingested_at, id) AS position, source FROM (SELECT DISTINCT source, id, ingested_at FROM messages WHERE id IS NOT NULL AND source IS NOT NULL)",
    "artifact_lines": f"""
        WITH {_ARTIFACTS} SELECT artifact_id, md5('{{' || concat_ws(',', '"artifact_id":' || to_json(artifact_id), '"container_id":' || to_json(container_id), '"parent_id":' || to_json(parent_id), '"sender_id":' || to_json(sender_id),
            '"source":' || to_json(source), '"text":' || to_json(text), '"ts":' || to_json(strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ'))) || '}}') AS line FROM artifacts
    """,
    "warning_report": """
        WITH a AS (SELECT * FROM email UNION ALL BY NAME SELECT * FROM ticket), w AS (
            SELECT source || ': no container_id' AS warning FROM a WHERE trim(coalesce(container_id, '')) = '' UNION ALL SELECT source || ': no sender_id' FROM a WHERE trim(coalesce(sender_id, '')) = ''
            UNION ALL SELECT source || ': no ts' FROM a WHERE trim(coalesce(ts, '')) = '' UNION ALL SELECT source || ': no text' FROM a WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '')
        SELECT warning, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, warning LIMIT 12
    """,
    "failure_report": f"""
        WITH {LINES_SQL}, f AS (SELECT file_name, line_no, coalesce(reason, 'duplicate_id') AS reason FROM nth WHERE reason IS NOT NULL OR place > 1)
        SELECT f.file_name, f.line_no, f.reason, replace(left(l.line, 200), chr(10), '\\n') AS raw FROM f JOIN slack_02_broken l ON l.file_name = f.file_name AND l.line_no = f.line_no ORDER BY f.file_name, f.line_no, l.line LIMIT 25
    """,
    "hidden_keys": " UNION ALL ".join(
        f"SELECT '{t}' AS of, count(*) AS rows, count(*) FILTER (len(list_filter(list_concat(coalesce(json_keys(CASE WHEN json_type(try_cast(meta AS JSON)) = 'OBJECT' THEN try_cast(meta AS JSON) END), []), coalesce(json_keys(CASE WHEN json_type(try_cast(raw AS JSON)) = 'OBJECT' THEN try_cast(raw AS JSON) END), [])), lambda k: starts_with(k, '_'))) > 0) AS hidden FROM {t}"
        for t in ("email", "ticket", "slack_01_clean")
    ),
    "unresolved_labels": "SELECT DISTINCT doc_id FROM subject_labels WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)",
    "disjoint_replies": f"""
        WITH {_ARTIFACTS}, w AS (SELECT artifact_id, container_id, parent_id, {_content('text')} AS w FROM artifacts)
        SELECT c.container_id, count(*) AS steps, count(*) FILTER (NOT list_has_any(c.w, p.w)) AS disjoint FROM w c JOIN w p ON p.artifact_id = c.parent_id GROUP BY 1
    """,
    "forbidden_phrases": f"WITH {_ARTIFACTS} " + " UNION ALL ".join(f"SELECT '{p}' AS phrase, count(*) FILTER (contains(lower(text), '{p}')) AS n FROM artifacts" for p in FORBIDDEN),
    "corpus_digests": f"WITH {_ARTIFACTS} SELECT source, count(*) AS n, CAST(sum(CAST('0x' || left(md5(artifact_id || '|' || coalesce(text, '~')), 8) AS BIGINT)) AS BIGINT) AS digest FROM artifacts GROUP BY 1",
    "fact_caps": f"""
        WITH {_ARTIFACTS}, f AS (SELECT DISTINCT artifact_id, fact FROM (SELECT artifact_id, unnest({_aliases('text')}) AS fact FROM artifacts)), t AS (SELECT count(DISTINCT fact) AS total FROM f), e AS (SELECT artifact_id, count(*) AS n FROM f GROUP BY 1)
        SELECT (SELECT total FROM t) AS total, (SELECT (total + 2) // 3 FROM t) AS cap, max(n) AS worst, count(*) FILTER (n > (SELECT (total + 2) // 3 FROM t)) AS over FROM e
    """,
    "silent_recipients": f"""
        WITH {_ARTIFACTS}, m AS (SELECT * FROM artifacts WHERE source = 'email'),
        r AS (SELECT DISTINCT artifact_id, container_id, epoch(ts) AS at, person FROM (SELECT artifact_id, container_id, ts, unnest(recipients) AS person FROM m WHERE parent_id IS NULL AND container_id IS NOT NULL AND ts IS NOT NULL) WHERE person IS NOT NULL)
        SELECT artifact_id, person FROM r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.container_id = r.container_id AND m.sender_id = r.person AND floor(epoch(m.ts)) - floor(r.at) BETWEEN 0 AND 172800)
    """,
    "corpus_loaded": """
        WITH a AS (SELECT * FROM email UNION ALL BY NAME SELECT * FROM ticket), k AS (SELECT *, trim(artifact_id) AS id FROM a WHERE trim(coalesce(artifact_id, '')) <> '')
        SELECT source, 'message' AS outcome, count(DISTINCT id) AS n FROM k WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY 1
        UNION ALL SELECT '', 'duplicate', count(*) - count(DISTINCT id) FROM k HAVING count(*) > count(DISTINCT id)
        UNION ALL SELECT '', 'no_id', count(*) FROM a WHERE trim(coalesce(artifact_id, '')) = '' HAVING count(*) > 0
    """,
    "asked_artifacts": f"""
        WITH {_ARTIFACTS}, {_KNOWN}, q AS (SELECT unnest(list_concat({_tokens(f"'{QUESTION}'")}, {_aliases(f"'{QUESTION}'")})) AS token), e AS (SELECT DISTINCT entity FROM known JOIN q USING (token)),
        a AS (SELECT artifact_id, unnest(list_distinct({_tokens('text')})) AS token FROM artifacts)
        SELECT DISTINCT artifact_id FROM a JOIN known USING (token) JOIN e USING (entity)
        UNION SELECT artifact_id FROM artifacts WHERE list_has_any(list_concat({_aliases('text')}, list_concat({_tokens('container_id')}, {_tokens('parent_id')})), {_aliases(f"'{QUESTION}'")})
    """,
    "answer_verdicts": f"""
        WITH {_ARTIFACTS}, {_EVIDENCE}
        SELECT CASE WHEN {_key('e.artifact_id')} IS NULL THEN 'names nobody' WHEN a.artifact_id IS NULL THEN 'cites unknown ids' ELSE 'sound' END AS verdict, count(*) AS n FROM evidence e LEFT JOIN artifacts a ON a.artifact_id = {_key('e.artifact_id')} GROUP BY 1
    """,
    "mail_bodies": rf"""
        WITH n AS MATERIALIZED (SELECT *, row_number() OVER () AS rn FROM gmail_raw),
        flat AS (
            SELECT rn, payload.mimeType AS mime, payload.body.data AS data, 0 AS i, 0 AS j FROM n
            UNION ALL SELECT rn, p.mimeType, p.body.data, i, 0 FROM (SELECT rn, unnest(payload.parts) AS p, generate_subscripts(payload.parts, 1) AS i FROM n)
            UNION ALL SELECT rn, q.mimeType, q.body.data, i, j FROM (SELECT rn, i, unnest(p.parts) AS q, generate_subscripts(p.parts, 1) AS j FROM (SELECT rn, unnest(payload.parts) AS p, generate_subscripts(payload.parts, 1) AS i FROM n))),
        texts AS (SELECT rn, mime, i, j, decode(from_base64(rpad(translate(data, '-_', '+/'), CAST(ceil(len(data) / 4.0) * 4 AS INTEGER), '='))) AS text FROM flat WHERE coalesce(data, '') <> '' AND mime IN ('text/plain', 'text/html')),
        bodies AS (
            SELECT rn, coalesce(arg_min(text, i * 1000 + j) FILTER (mime = 'text/plain'),
                regexp_replace(replace(replace(replace(regexp_replace(arg_min(text, i * 1000 + j) FILTER (mime = 'text/html'), '<[^>]+>', ' ', 'g'), '&mdash;', '—'), '&nbsp;', ' '), '&amp;', '&'), '[ \t]+', ' ', 'g')) AS body FROM texts GROUP BY 1),
        cut AS (SELECT rn, regexp_split_to_array(regexp_replace(body, '\r\n?', chr(10), 'g'), '(?m)^[ \t]*On .{{0,120}}?\bwrote:[ \t]*$|^[ \t]*-{{2,}}[ \t]*Original Message[ \t]*-{{2,}}[ \t]*$')[1] AS body FROM bodies),
        own AS (SELECT rn, array_to_string(list_filter(string_split(body, chr(10)), lambda x: NOT starts_with(ltrim(x), '>')), chr(10)) AS body FROM cut),
        signed AS (SELECT rn, trim(regexp_split_to_array(body, '(?m)^--[ \t]*$')[1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) AS body FROM own),
        heads AS (
            SELECT rn, id, trim(snippet) AS snippet, list_filter(payload.headers, lambda h: lower(trim(h.name)) = 'from')[1].value AS sender, trim(coalesce(list_filter(payload.headers, lambda h: lower(trim(h.name)) = 'subject')[1].value, '')) AS subject FROM n),
        a AS ({instants_sql("SELECT rn AS src, id AS rec_id, trim(internalDate) AS s, NULL AS z, NULL AS o FROM n")}),
        b AS ({instants_sql("SELECT rn AS src, id AS rec_id, trim(list_filter(payload.headers, lambda h: lower(trim(h.name)) = 'date')[1].value) AS s, NULL AS z, NULL AS o FROM n")}),
        x AS (SELECT h.*, coalesce(nullif(s.body, ''), nullif(h.snippet, '')) AS body, coalesce(a.epoch_ms, b.epoch_ms) AS epoch_ms FROM heads h LEFT JOIN signed s USING (rn) LEFT JOIN a ON a.src = h.rn LEFT JOIN b ON b.src = h.rn)
        SELECT DISTINCT id, coalesce(nullif(regexp_extract(sender, '<([^>]+)>', 1), ''), nullif(trim(sender), ''), 'unknown') AS sender, epoch_ms, CASE WHEN subject <> '' THEN 'Subject: ' || subject || chr(10) || chr(10) ELSE '' END || body AS text FROM x WHERE body IS NOT NULL
    """,
    "p2_unified": f"""
        WITH RECURSIVE place AS (SELECT file_name, stream, file_no AS no FROM export_files WHERE feed = 'slack_01_clean'),
        ends AS (SELECT stream, field, no, max(new_field) FILTER (change = 'renamed') AS name FROM ({PROBLEMS["p2_found"]}) JOIN place USING (file_name) WHERE change IN ('renamed', 'removed') GROUP BY 1, 2, 3),
        hop AS (SELECT e.stream, e.field, e.no, e.name, n.no AS next_no, n.name AS next_name FROM (SELECT * FROM ends WHERE name IS NOT NULL) e ASOF LEFT JOIN ends n ON n.stream = e.stream AND n.field = e.name AND e.no < n.no),
        walk AS (
            SELECT stream, field, no, name, next_no, next_name FROM hop
            UNION SELECT w.stream, w.field, w.no, h.name, h.next_no, h.next_name FROM walk w JOIN hop h ON h.stream = w.stream AND h.field = w.name AND h.no = w.next_no WHERE w.next_name IS NOT NULL),
        last AS (SELECT stream, field, no, name FROM walk WHERE next_name IS NULL),
        lines AS MATERIALIZED (SELECT *, row_number() OVER () AS rn FROM slack_01_clean),
        cells AS (
            SELECT rn, file_name, 'meta.' || e.key AS field, e.type AS type, CAST(e.value AS VARCHAR) AS value FROM (SELECT rn, file_name, try_cast(meta AS JSON) AS j FROM lines) t, json_each(CASE WHEN json_type(j) = 'OBJECT' THEN j ELSE JSON '{{}}' END) e
            UNION ALL SELECT rn, file_name, 'raw.' || e.key, e.type, CAST(e.value AS VARCHAR) FROM (SELECT rn, file_name, try_cast(raw AS JSON) AS j FROM lines) t, json_each(CASE WHEN json_type(j) = 'OBJECT' THEN j ELSE JSON '{{}}' END) e),
        borne AS (SELECT DISTINCT file_name, field, stream, no FROM cells JOIN place USING (file_name) WHERE type <> 'NULL'),
        renamed AS (SELECT b.file_name, b.field, l.name FROM (SELECT b.*, e.no AS end_no FROM borne b ASOF JOIN ends e ON e.stream = b.stream AND e.field = b.field AND b.no < e.no) b JOIN last l ON l.stream = b.stream AND l.field = b.field AND l.no = b.end_no),
        named AS (
            SELECT c.rn, coalesce(r.name, c.field) AS name, {_BY_NAME} AS value FROM cells c LEFT JOIN renamed r ON r.file_name = c.file_name AND r.field = c.field
            QUALIFY row_number() OVER (PARTITION BY c.rn, coalesce(r.name, c.field) ORDER BY coalesce(r.name, c.field) <> c.field, c.field) = 1),
        joined AS (SELECT rn, '{{' || string_agg(to_json(name) || ':' || to_json(value), ',' ORDER BY name) || '}}' AS fields FROM named GROUP BY 1)
        SELECT file_name, line_no, artifact_id, coalesce(fields, '{{}}') AS fields FROM lines LEFT JOIN joined USING (rn)
    """,
}
