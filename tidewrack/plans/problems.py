"""Queries of the general data problems: stamps, drift, failed lines, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.operators import drift, orphans, quarantine, timestamps
from tidewrack.sources.tables import table

_REFERENCE_TABLES = ("email", "ticket", "slack_01_clean", "topic_evidence", "employees", "externals", "tombstones")


def _reference_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in _REFERENCE_TABLES}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalized_stamps(table(spark, d, "messages"), table(spark, d, "gmail_raw"), table(spark, d, "slack_01_clean"), table(spark, d, "export_files")).drop("zone_version")


def p1_shapes(spark: SparkSession, d: str) -> DataFrame:
    stamps = [table(spark, d, t, F.col(c).alias("stamp")) for t, c in (("messages", "timestamp"), ("slack_01_clean", "ts"), ("gmail_raw", "internalDate"))]
    return timestamps.stamp_shapes(stamps[0].unionByName(stamps[1]).unionByName(stamps[2]), "stamp")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "slack_01_clean", "file_name", "line_no", "artifact_id", "meta", "raw"), table(spark, d, "export_files"))


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified_table(table(spark, d, "slack_01_clean"), table(spark, d, "export_files")).withColumn("fields", F.to_json("fields"))


def p2_scripts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "slack_01_clean", "file_name", "line_no", "artifact_id", "meta", "raw")
    x = drift.schema_scripts(lines, table(spark, d, "export_files"), depth=None).where("change <> 'kept'")
    return x.select("file_name", "change", F.array_join("old", ".").alias("field"), F.array_join("new", ".").alias("new_field"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.failed_lines(table(spark, d, "slack_02_broken")).select("file_name", "line_no", "reason").distinct()


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.valid_records(table(spark, d, "slack_02_broken"))


def p4_recovered(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.recovered_records(table(spark, d, "slack_02_broken"))


def p4_fields(spark: SparkSession, d: str) -> DataFrame:
    x = quarantine.valid_records(table(spark, d, "slack_02_broken")).select("file_name", "line_no", "artifact_id", F.explode("fields").alias("f"))
    return x.groupBy("file_name", F.col("f.name").alias("field"), F.col("f.type").alias("type")).agg(F.count("*").alias("n"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cascade = orphans.orphan_cascade(_reference_tables(spark, d))
    return cascade.where("level = 0").select("ref_table", "ref_field", "row_key", "kind", "period")


def p6_cascade(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(orphans.orphan_cascade(_reference_tables(spark, d)))


def p6_threads(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(orphans.orphan_cascade(_reference_tables(spark, d), orphans.THREAD_REFERENCES))


QUERIES = {f.__name__: f for f in (p1_found, p1_shapes, p2_found, p2_scripts, p2_unified, p4_found, p4_loaded, p4_fields, p4_recovered, p6_found, p6_cascade, p6_threads)}

_KEY = "nullif(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '')"

_ORPHANS = f"""
    tomb AS (SELECT lower(trim(source_table)) AS target, {_KEY.format('artifact_id')} AS id, min(deleted_at) AS gone_at FROM tombstones GROUP BY 1, 2),
    things AS (
        SELECT target, id, min(loaded_at) AS came_at FROM (
            SELECT 'email' AS target, {_KEY.format('artifact_id')} AS id, loaded_at FROM email
            UNION ALL SELECT 'ticket', {_KEY.format('artifact_id')}, loaded_at FROM ticket
            UNION ALL SELECT 'slack_01_clean', {_KEY.format('artifact_id')}, loaded_at FROM slack_01_clean) GROUP BY 1, 2),
    targets AS (
        SELECT t.target, t.id, t.came_at, g.gone_at FROM things t LEFT JOIN tomb g ON g.target = t.target AND g.id = t.id
        UNION ALL SELECT 'people', id, min(loaded_at), min(left_at) FROM (
            SELECT {_KEY.format('employee_id')} AS id, loaded_at, left_at FROM employees
            UNION ALL SELECT {_KEY.format('entity_id')}, loaded_at, NULL FROM externals) GROUP BY 2),
    refs AS (
        SELECT 'ticket' AS ref_table, 'parent_id' AS ref_field, artifact_id AS row_key, parent_id AS reference, loaded_at FROM ticket
        UNION ALL SELECT 'email', 'sender_id', artifact_id, sender_id, loaded_at FROM email
        UNION ALL SELECT 'topic_evidence', 'artifact_id', evidence_id, artifact_id, loaded_at FROM topic_evidence),
    firsts AS (
        SELECT ref_table, ref_field, trim(row_key) AS row_key, {_KEY.format('reference')} AS to_id, loaded_at FROM refs
        QUALIFY row_number() OVER (PARTITION BY ref_table, {_KEY.format('row_key')} ORDER BY loaded_at, reference NULLS FIRST, row_key) = 1),
    states AS (
        SELECT f.*, CASE WHEN count(t.id) = 0 THEN 'missing' WHEN count(t.id) = count(t.gone_at) AND max(t.gone_at) <= f.loaded_at THEN 'deleted' WHEN min(t.came_at) > f.loaded_at THEN 'late' END AS kind
        FROM firsts f LEFT JOIN targets t ON t.id = f.to_id AND (CASE f.ref_table WHEN 'ticket' THEN t.target = 'ticket' WHEN 'email' THEN t.target = 'people' ELSE t.target IN ('email', 'ticket', 'slack_01_clean') END)
        WHERE f.to_id IS NOT NULL GROUP BY f.ref_table, f.ref_field, f.row_key, f.to_id, f.loaded_at)
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def _json_value(depth: int) -> str:
    """Strict JSON up to a depth, as a regular expression."""
    ws, text = r"[ \t\n\r]*", r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
    plain = rf"(?:{text}|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null"
    if not depth:
        return plain + ")"
    v = _json_value(depth - 1)
    return rf"{plain}|\[{ws}(?:{v}{ws}(?:,{ws}{v}{ws})*)?\]|\{{{ws}(?:{text}{ws}:{ws}{v}{ws}(?:,{ws}{text}{ws}:{ws}{v}{ws})*)?\}})"


_STRICT = rf"[ \t\n\r]*{_json_value(3)}[ \t\n\r]*"
FIELDS_SQL = " UNION ALL ".join(
    f"SELECT file_name, {_KEY.format('artifact_id')} AS a, '{c}.' || e.key AS field, CASE e.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS type, CAST(e.value AS VARCHAR) AS value "
    f"FROM (SELECT file_name, artifact_id, try_cast({c} AS JSON) AS j FROM slack_01_clean) t, json_each(CASE WHEN json_type(j) = 'OBJECT' THEN j ELSE JSON '{{}}' END) e WHERE e.type <> 'NULL'"
    for c in ("meta", "raw")
)

_BODY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, ' ?\([a-z]+\)$|\[[A-Za-z/_]+\]$', ''), '(:\d\d)[.,]\d+', '\1'), '([:T]\d\d(?::?\d\d){0,2})(?: ?[+-]\d\d:?(?:\d\d)?| ?(?:[A-Za-z]+/[A-Za-z_]+|UTC|GMT|[ECMP][SD]T|[Zz]))$', '\1'), '^[A-Z][a-z][a-z], ', '')"
_FORMATS = ", ".join(f"'{f}'" for f in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y%m%dT%H%M%S", "%d %b %Y %H:%M:%S", "%d %B %Y %H:%M:%S", "%d. %B %Y %H:%M", "%b %d, %Y, %I:%M:%S %p"))
_OFFSETS = "MAP {'Z': 0, 'UTC': 0, 'GMT': 0, 'EST': -300, 'EDT': -240, 'CST': -360, 'CDT': -300, 'MST': -420, 'MDT': -360, 'PST': -480, 'PDT': -420}"


def instants_sql(rows: str) -> str:
    """epoch_ms of (src, rec_id, s, z, o) where s denotes an instant."""
    return rf"""
        SELECT src, rec_id, CASE
            WHEN regexp_full_match(s, '\d+(\.\d+)?') THEN CASE WHEN i BETWEEN 978307200 AND 4102444799 THEN i * 1000 + CAST(rpad(substr(split_part(s, '.', 2), 1, 3), 3, '0') AS BIGINT) WHEN i // 1000 BETWEEN 978307200 AND 4102444799 THEN i WHEN i // 1000000 BETWEEN 978307200 AND 4102444799 THEN i // 1000 END
            WHEN off <> '' THEN epoch_ms(b) + f - CASE WHEN off LIKE '-%' THEN -1 ELSE 1 END * (CAST(substr(off, 2, 2) AS BIGINT) * 60 + CAST('0' || substr(replace(off, ':', ''), 4, 2) AS BIGINT)) * 60000
            WHEN abbr <> '' THEN epoch_ms(b) + f - {_OFFSETS}[upper(abbr)] * 60000
            ELSE epoch_ms(CASE WHEN timezone(zone, u) = b THEN u WHEN timezone(zone, timezone(zone, b)) = b THEN timezone(zone, b) ELSE u END) + f END AS epoch_ms
        FROM (SELECT *, timezone(zone, b - INTERVAL 3 HOUR) + INTERVAL 3 HOUR AS u FROM (
            SELECT src, rec_id, s, try_cast(split_part(s, '.', 1) AS BIGINT) AS i, CAST('0' || rpad(substr(regexp_extract(s, ':\d\d[.,](\d+)', 1), 1, 3), 3, '0') AS BIGINT) AS f,
                   regexp_extract(s, '[:T]\d\d(?::?\d\d)?(?:[.,]\d+)? ?([+-]\d\d:?(?:\d\d)?)', 1) AS off, regexp_extract(s, '[0-9] ?([Zz]|UTC|GMT|[ECMP][SD]T)$', 1) AS abbr,
                   coalesce(nullif(regexp_extract(s, ' ([A-Za-z]+/[A-Za-z_]+)$', 1), ''), z, 'UTC') AS zone,
                   coalesce(try_strptime({_BODY}, [{_FORMATS}]), CASE WHEN o = 'mdy' THEN try_strptime(s, ['%m/%d/%Y %I:%M:%S %p', '%m/%d/%Y %I:%M %p']) WHEN o = 'dmy' THEN try_strptime(s, ['%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M']) END) AS b
            FROM ({rows})))
    """


LINES_SQL = rf"""
    l AS (
            SELECT file_name, line_no, ends_with(lower(file_name), '.csv') AS is_csv, CASE WHEN line_no = 1 THEN ltrim(line, chr(65279)) ELSE line END AS line FROM slack_02_broken WHERE line IS NOT NULL AND file_name IS NOT NULL),
        c AS (SELECT *, rtrim(line, chr(13) || chr(10)) AS r, len(regexp_replace(rtrim(line, chr(13) || chr(10)), '"(?:[^"]|"")*"|[^,]', '', 'g')) AS commas FROM l),
        h AS (SELECT file_name, commas FROM c WHERE is_csv AND line_no = 1),
        j AS (
            SELECT file_name, line_no, is_csv, r, c.commas, h.commas AS want, regexp_full_match(line, '{_STRICT.replace("'", "''")}') AS strict, try_cast(line AS JSON) AS v
            FROM c LEFT JOIN h USING (file_name) WHERE trim(line, {_BLANKS}) <> '' AND NOT (is_csv AND line_no = 1)),
        k AS (
            SELECT *, CASE WHEN is_csv THEN trim(CASE WHEN r LIKE '"%' THEN replace(regexp_extract(r, '^"((?:[^"]|"")*)"', 1), '""', '"') ELSE split_part(r, ',', 1) END, {_BLANKS})
                           ELSE trim(CASE WHEN json_type(v, '$.artifact_id') = 'VARCHAR' THEN v ->> '$.artifact_id' ELSE CAST(v -> '$.artifact_id' AS VARCHAR) END, {_BLANKS}) END AS id,
                   json_type(v, '$.artifact_id') AS id_type, json_type(v, '$.text') AS text_type FROM j),
        m AS (
            SELECT *, CASE WHEN is_csv THEN CASE WHEN NOT regexp_full_match(r, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') THEN 'bad_quoting' WHEN commas <> want THEN 'column_count' WHEN id = '' THEN 'no_id' END
                ELSE CASE WHEN NOT strict THEN 'bad_json' WHEN json_type(v) <> 'OBJECT' THEN 'not_object' WHEN coalesce(id_type, 'NULL') = 'NULL' OR (id_type = 'VARCHAR' AND id = '') THEN 'no_id'
                          WHEN id_type NOT IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') OR coalesce(text_type, 'NULL') NOT IN ('NULL', 'VARCHAR') THEN 'bad_value' END END AS reason FROM k),
    nth AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY reason IS NULL, id ORDER BY file_name, line_no) ELSE 0 END AS place FROM m)
"""

ORACLE = {
    "p1_found": f"""
        WITH a AS ({instants_sql("SELECT 'messages' AS src, id AS rec_id, trim(timestamp) AS s, zone AS z, date_order AS o FROM messages LEFT JOIN (SELECT * FROM export_files WHERE feed = 'messages') USING (file_name) UNION ALL SELECT 'slack_01_clean', file_name || ':' || line_no, trim(ts), zone, date_order FROM slack_01_clean LEFT JOIN (SELECT * FROM export_files WHERE feed = 'slack_01_clean') USING (file_name)")}),
        g AS ({instants_sql("SELECT row_number() OVER () AS src, id AS rec_id, trim(internalDate) AS s, NULL AS z, NULL AS o FROM gmail_raw")}),
        h AS ({instants_sql("SELECT row_number() OVER () AS src, id AS rec_id, trim(list_filter(payload.headers, lambda h: lower(h.name) = 'date')[1].value) AS s, NULL AS z, NULL AS o FROM gmail_raw")})
        SELECT DISTINCT * FROM (SELECT * FROM a UNION ALL SELECT 'gmail_raw', rec_id, coalesce(g.epoch_ms, h.epoch_ms) FROM g JOIN h USING (src, rec_id)) WHERE epoch_ms IS NOT NULL
    """,
    "p2_found": f"""
        WITH f AS (SELECT DISTINCT file_name, a, field, type, value FROM ({FIELDS_SQL})),
        pairs AS (SELECT file_name, lag(file_name) OVER (PARTITION BY stream ORDER BY file_no, file_name) AS prev FROM export_files WHERE feed = 'slack_01_clean' QUALIFY prev IS NOT NULL),
        types AS (SELECT file_name, field, list_sort(list(DISTINCT type)) AS types FROM f GROUP BY 1, 2),
        pair AS (
            SELECT coalesce(n.file_name, o.file_name) AS file_name, coalesce(n.prev, o.prev) AS prev, coalesce(n.field, o.field) AS field, n.types AS new, o.types AS old
            FROM (SELECT p.*, t.field, t.types FROM pairs p JOIN types t ON t.file_name = p.file_name) n
            FULL JOIN (SELECT p.*, t.field, t.types FROM pairs p JOIN types t ON t.file_name = p.prev) o ON o.file_name = n.file_name AND o.field = n.field),
        agree AS (
            SELECT g.file_name, g.field AS old, b.field AS new FROM (SELECT * FROM pair WHERE new IS NULL) g JOIN (SELECT * FROM pair WHERE old IS NULL) b ON b.file_name = g.file_name
            JOIN f o ON o.file_name = g.prev AND o.field = g.field JOIN f n ON n.file_name = g.file_name AND n.field = b.field AND n.a = o.a
            GROUP BY 1, 2, 3 HAVING bool_and(n.type = o.type AND n.value = o.value)),
        renamed AS (SELECT * FROM agree QUALIFY count(*) OVER (PARTITION BY file_name, old) = 1 AND count(*) OVER (PARTITION BY file_name, new) = 1)
        SELECT file_name, old AS field, 'renamed' AS change, new AS new_field FROM renamed
        UNION ALL SELECT file_name, field, 'removed', '' FROM pair b WHERE new IS NULL AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_name = b.file_name AND r.old = b.field)
        UNION ALL SELECT file_name, field, 'added', '' FROM pair b WHERE old IS NULL AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_name = b.file_name AND r.new = b.field)
        UNION ALL SELECT file_name, field, 'retyped', '' FROM pair WHERE old <> new
    """,
    "p4_found": f"WITH {LINES_SQL} SELECT DISTINCT file_name, line_no, coalesce(reason, 'duplicate_id') AS reason FROM nth WHERE reason IS NOT NULL OR place > 1",
    "p4_fields": f"""
        WITH {LINES_SQL}, names AS (SELECT file_name, string_split(rtrim(r, chr(13) || chr(10)), ',') AS names FROM c WHERE is_csv AND line_no = 1), loaded AS (SELECT * FROM nth WHERE reason IS NULL AND place = 1)
        SELECT file_name, field, type, count(*) AS n FROM (
            SELECT l.file_name, e.key AS field, CASE e.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type FROM (SELECT * FROM loaded WHERE NOT is_csv) l, json_each(l.v) e
            UNION ALL SELECT file_name, unnest(names), 'string' FROM loaded JOIN names USING (file_name) WHERE is_csv) GROUP BY 1, 2, 3
    """,
    "p1_shapes": """
        SELECT coalesce(regexp_replace(regexp_replace(trim(stamp, ' ' || chr(9) || chr(10) || chr(13)), '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g'), 'null') AS shape, count(*) AS n
        FROM (SELECT timestamp AS stamp FROM messages UNION ALL SELECT ts FROM slack_01_clean UNION ALL SELECT internalDate FROM gmail_raw) GROUP BY 1
    """,
    "p6_found": f"WITH {_ORPHANS} SELECT ref_table, ref_field, row_key, kind, strftime(loaded_at, '%Y-%m') AS period FROM states WHERE kind IS NOT NULL",
    "p6_cascade": f"""
        WITH RECURSIVE {_ORPHANS},
        down AS (
            SELECT {_KEY.format('row_key')} AS id, kind, 0 AS level, ref_table FROM states WHERE kind IS NOT NULL
            UNION SELECT {_KEY.format('s.row_key')}, d.kind, d.level + 1, 'ticket' FROM states s JOIN down d ON s.to_id = d.id WHERE s.ref_table = 'ticket' AND d.ref_table = 'ticket' AND s.kind IS NULL),
        tickets AS (SELECT id, min(level) AS level, min_by(kind, level * 10 + CASE kind WHEN 'deleted' THEN 0 WHEN 'late' THEN 1 ELSE 2 END) AS kind FROM down WHERE ref_table = 'ticket' GROUP BY id),
        sources AS (SELECT id, level, kind FROM tickets UNION ALL SELECT id, level, kind FROM down WHERE ref_table = 'email'),
        evidence AS (
            SELECT s.row_key, s.loaded_at, min_by(o.kind, o.level * 10 + CASE o.kind WHEN 'deleted' THEN 0 WHEN 'late' THEN 1 ELSE 2 END) AS kind
            FROM states s JOIN sources o ON o.id = s.to_id WHERE s.ref_table = 'topic_evidence' AND s.kind IS NULL GROUP BY 1, 2),
        every AS (
            SELECT ref_table, ref_field, strftime(loaded_at, '%Y-%m') AS period, kind, 1 AS direct, 0 AS inherited FROM states WHERE kind IS NOT NULL
            UNION ALL SELECT 'ticket', 'parent_id', strftime(s.loaded_at, '%Y-%m'), t.kind, 0, 1 FROM tickets t JOIN states s ON s.ref_table = 'ticket' AND {_KEY.format('s.row_key')} = t.id WHERE t.level > 0
            UNION ALL SELECT 'topic_evidence', 'artifact_id', strftime(loaded_at, '%Y-%m'), kind, 0, 1 FROM evidence)
        SELECT ref_table, ref_field, period, kind, CAST(sum(direct) AS BIGINT) AS direct, CAST(sum(inherited) AS BIGINT) AS inherited FROM every GROUP BY 1, 2, 3, 4
    """,
    "p6_threads": f"""
        WITH RECURSIVE {_ORPHANS},
        answers AS (
            SELECT 'email' AS ref_table, 'parent_id' AS ref_field, trim(artifact_id) AS row_key, {_KEY.format('parent_id')} AS to_id, loaded_at FROM email
            QUALIFY row_number() OVER (PARTITION BY {_KEY.format('artifact_id')} ORDER BY loaded_at, parent_id NULLS FIRST) = 1),
        every AS (
            SELECT *, {_KEY.format('row_key')} AS id FROM states UNION ALL
            SELECT a.*, CASE WHEN t.id IS NULL THEN 'missing' WHEN t.gone_at <= a.loaded_at THEN 'deleted' WHEN t.came_at > a.loaded_at THEN 'late' END, {_KEY.format('row_key')}
            FROM answers a LEFT JOIN targets t ON t.target = 'email' AND t.id = a.to_id WHERE a.to_id IS NOT NULL),
        down AS (
            SELECT ref_table, id, kind, 0 AS level FROM every WHERE kind IS NOT NULL
            UNION SELECT e.ref_table, e.id, d.kind, d.level + 1 FROM every e JOIN down d ON d.id = e.to_id AND d.ref_table = e.ref_table WHERE e.kind IS NULL AND e.ref_field = 'parent_id'),
        best AS (SELECT ref_table, id, arg_min(kind, level * 10 + CASE kind WHEN 'deleted' THEN 0 WHEN 'late' THEN 1 ELSE 2 END) AS kind, min(level) AS level FROM down GROUP BY 1, 2),
        taken AS (
            SELECT e.ref_table, e.ref_field, e.row_key, e.loaded_at, arg_min(b.kind, b.level * 10 + CASE b.kind WHEN 'deleted' THEN 0 WHEN 'late' THEN 1 ELSE 2 END) AS kind
            FROM every e JOIN best b ON b.id = e.to_id AND CASE e.ref_field WHEN 'parent_id' THEN b.ref_table = e.ref_table WHEN 'artifact_id' THEN b.ref_table IN ('email', 'ticket') ELSE false END
            WHERE e.kind IS NULL GROUP BY 1, 2, 3, 4)
        SELECT ref_table, ref_field, strftime(loaded_at, '%Y-%m') AS period, kind, CAST(sum(direct) AS BIGINT) AS direct, CAST(sum(1 - direct) AS BIGINT) AS inherited
        FROM (SELECT ref_table, ref_field, loaded_at, kind, 1 AS direct FROM every WHERE kind IS NOT NULL UNION ALL SELECT ref_table, ref_field, loaded_at, kind, 0 FROM taken) GROUP BY 1, 2, 3, 4
    """,
}
