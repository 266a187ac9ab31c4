"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

from factloom.llm.centroids import CLUSTERS, DIMENSIONS, ROUNDS, SCALE
from factloom.llm.chat import TEMPLATE
from factloom.llm.queries import CONTROL_TALK, URL_RULES

_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Characters a turn's marks take, by role; other roles carry their escaped name.
_MARKS = " ".join(f"WHEN '{name}' THEN {len(t.before) + len(t.after)}" for name, t in TEMPLATE.roles.items())
_OTHER = len(TEMPLATE.other_before) + len(TEMPLATE.other_between) + len(TEMPLATE.other_after)
_CONTROL = TEMPLATE.control().replace("'", "''")
_ESCAPES = "length(regexp_replace({0}, '" + _CONTROL + r"', '\1\2\\\3', 'g'))"


def _rounds(rounds: int) -> str:
    """Rounds of clustering: each assigns the vectors to centroids{i} and makes centroids{i + 1}."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
            SELECT line, min((distance, cluster)) AS best
            FROM (SELECT v.line, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance
                  FROM parts v JOIN centroids{i} c USING (place) GROUP BY ALL)
            GROUP BY line
        )""")
        if i < rounds:
            steps.append(f"""centroids{i + 1} AS MATERIALIZED (
            SELECT cluster, place, coalesce(moved.x, old.x) AS x
            FROM centroids{i} old LEFT JOIN (
                SELECT best[2] AS cluster, place,
                       ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
                FROM parts JOIN near{i} USING (line) GROUP BY ALL
            ) moved USING (cluster, place)
        )""")
    return ", ".join(steps)


ORACLES = {
    "op2_url_filter": f"""
        WITH cut AS (
            SELECT page_id, row_number() OVER () AS line,
                   CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), parts AS (
            SELECT page_id, line,
                   translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), rules(rule_host, rule_path, verdict) AS (VALUES {_RULES}), fits AS (
            SELECT line, rule_host || rule_path AS rule, verdict,
                   row_number() OVER (PARTITION BY line ORDER BY length(rule_host || rule_path) DESC,
                                      length(rule_host) DESC, verdict = 'block' DESC) AS place
            FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
                                 AND starts_with(path, rule_path)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (line)
    """,
    "op5_exact_dedup": """
        WITH docs AS (
            SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY coalesce(text, '')
                   ORDER BY doc_id DESC NULLS LAST) AS place FROM documents
        )
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, place = 1 AS kept,
               sha256(text) AS text_sha256
        FROM docs WINDOW same AS (PARTITION BY text)
    """,
    "op7_chat_format": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '{CONTROL_TALK}'), (-7, 1, 'assistant', '{CONTROL_TALK}')
        ), stepped AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM turns
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                               FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum({_ESCAPES.format("text")}
                        + CASE role {_MARKS} ELSE {_OTHER} + {_ESCAPES.format("role")} END) AS BIGINT) AS formatted_chars,
               bool_and(coalesce(before || '|', 'start|') || role IN (
                   {", ".join(f"'{state}|{role}'" for state, role in TEMPLATE.order)})) AS in_order
        FROM stepped GROUP BY conv_id
    """,
    "op10_warc": """
        WITH all_pages AS (
            SELECT page_id, coalesce(html, '') AS html FROM pages
        ), known AS (
            SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS response_id FROM all_pages
        ), hashed AS (
            SELECT page_id, response_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM known
        ), bits AS (
            SELECT *, list_transform(range(1, 9), lambda k: CAST('0x' || substr(hex, CAST((k - 1) * 5 + 1 AS INT), 5) AS BIGINT)) AS parts
            FROM hashed
        )
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(parts, lambda x: list_aggregate(list_transform([15, 10, 5, 0],
                   lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> s) & 31) + 1 AS INT), 1)),
                   'string_agg', '')), 'string_agg', '') AS payload_digest,
               CASE WHEN response_id IS NULL OR page_id IS NOT DISTINCT FROM response_id THEN 'response'
                    ELSE 'revisit' END AS record_type,
               CASE WHEN response_id IS NULL OR page_id IS NOT DISTINCT FROM response_id THEN NULL
                    ELSE response_id END AS refers_to
        FROM bits
    """,
    "op12_repair": """
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
            FROM conversations
        ), summed AS (
            SELECT *, xor(4294967295, list_reduce(
                flatten(list_transform(string_split(key, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))::BIGINT[],
                lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT
            )) % 20 AS damage
            FROM keyed
        ), hurt AS (
            SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM summed
        ), numbered AS (
            SELECT *, dense_rank() OVER (ORDER BY conv_id) AS conv,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
                   regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final
            FROM hurt
        ), turns AS MATERIALIZED (
            SELECT conv_id, conv, i, turn, role, text, substr(role, 1, 1) AS initial,
                   CASE WHEN final = '' THEN 'blank'
                        WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
                        WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                   lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) || substr(role, 1, 1) AS pair
            FROM numbered
        ), inserts(state, reached, price, letters, lines) AS (VALUES
            ('0', '0', 0, '', ''), ('0', 'u', 2, 'I', chr(10) || 'user:'),
            ('0', 'a', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
            ('s', 's', 0, '', ''), ('s', 'u', 2, 'I', chr(10) || 'user:'),
            ('s', 'a', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
            ('u', 'u', 0, '', ''), ('u', 'a', 2, 'I', chr(10) || 'assistant:'),
            ('a', 'a', 0, '', ''), ('a', 'u', 2, 'I', chr(10) || 'user:')
        ), edits(reached, letter, initial, after, price, name) AS (VALUES
            ('0', 'D', NULL, '0', 3, ''), ('s', 'D', NULL, 's', 3, ''), ('u', 'D', NULL, 'u', 3, ''), ('a', 'D', NULL, 'a', 3, ''),
            ('0', 'K', 's', 's', 0, ''), ('0', 'K', 'u', 'u', 0, ''), ('s', 'K', 'u', 'u', 0, ''), ('a', 'K', 'u', 'u', 0, ''),
            ('u', 'K', 'a', 'a', 0, ''), ('0', 'R', NULL, 'u', 2, 'user'), ('s', 'R', NULL, 'u', 2, 'user'),
            ('a', 'R', NULL, 'u', 2, 'user'), ('u', 'R', NULL, 'a', 2, 'assistant')
        ), steps AS MATERIALIZED (
            SELECT state, after, n.price + e.price AS price, n.letters || e.letter AS letters, lines, letter, initial, name
            FROM inserts n JOIN edits e USING (reached)
        ), walk AS (
            SELECT DISTINCT conv, 0::BIGINT AS i, '0' AS state, ROW(0::BIGINT, '', '') AS best FROM turns
            UNION ALL
            SELECT conv, i, state, min(best)
            FROM (SELECT w.conv, t.i, s.after AS state,
                         ROW(w.best[1] + s.price + (s.letter <> 'D' AND t.fault = 'truncated')::BIGINT, w.best[2] || s.letters,
                             w.best[3] || s.lines || CASE s.letter WHEN 'D' THEN ''
                             WHEN 'K' THEN chr(10) || t.role || ':' || t.text ELSE chr(10) || s.name || ':' || t.text END) AS best
                  FROM walk w JOIN turns t ON t.conv = w.conv AND t.i = w.i + 1 JOIN steps s ON s.state = w.state
                  WHERE (s.initial IS NULL OR s.initial = t.initial) AND (s.letter = 'D' OR t.fault NOT IN ('blank', 'duplicate')))
            GROUP BY conv, i, state
        ), counted AS (
            SELECT conv_id, conv, max(i) AS n,
                   coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM turns GROUP BY conv_id, conv
        ), ended AS (
            SELECT conv, min(ROW(best[1] + price, best[2] || letters, best[3] || lines)) AS best
            FROM walk JOIN counted USING (conv) JOIN inserts USING (state)
            WHERE i = n AND reached IN ('0', 'a') GROUP BY conv
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best[1], 0) AS cost,
               coalesce(best[2], '') AS audit, sha256(coalesce(substr(best[3], 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended USING (conv)
    """,
    "op13_centroids": f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, row_number() OVER () AS line,
                   list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS vector
            FROM embeddings
            WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS MATERIALIZED (
            SELECT line, unnest(range(1, {DIMENSIONS} + 1)) AS place, unnest(vector) AS x FROM kept
        ), first AS (
            SELECT line, row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), vector) - 1 AS cluster
            FROM kept QUALIFY cluster < {CLUSTERS}
        ), centroids0 AS MATERIALIZED (
            SELECT cluster, place, x FROM first JOIN parts USING (line)
        ), {_rounds(ROUNDS)}, found AS (
            SELECT line, best[2] AS cluster, best[1]::BIGINT AS distance FROM near{ROUNDS}
        ), named AS (
            SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY place)) AS centroid_sha256
            FROM centroids{ROUNDS} GROUP BY cluster
        )
        SELECT vec_id, cluster::INTEGER AS cluster, distance,
               (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
               (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM found JOIN kept USING (line) JOIN named USING (cluster)
    """,
}
