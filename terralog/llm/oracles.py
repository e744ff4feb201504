"""SQL of the operators on conversations, vectors and mixes, for small tables."""

from __future__ import annotations

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _step(value: str, cost: str, letter: str, line: str) -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN {{'c': {value}.c + {cost}, 'a': {value}.a || '{letter}', 't': {value}.t || {line}}} END"


def _least(*values: str) -> str:
    return f"list_min([{', '.join(values)}])"


def conversation_repair() -> str:
    """States 0 (nothing yet), 1 (system), 2 (user) and 3 (assistant) hold the least (cost, audit, lines) after each row."""
    insert = lambda v, name: _step(v, "3", "I", f"['{name}:']")
    keep = lambda v: _step(v, "late", "K", "[role || ':' || text]")
    rerole = lambda v, name: _step(v, "(3 + late)", "R", f"['{name}:' || text]")
    delete = lambda v: _step(v, "4", "D", "[]::VARCHAR[]")
    u = _least("s2", insert("s0", "user"), insert("s1", "user"), insert("s3", "user"))
    crc = "list_reduce([4294967295::BIGINT] || list_transform(string_split(mark, ''), lambda c: unicode(c)::BIGINT), lambda s, b: list_reduce([xor(s, b)] || [0::BIGINT for i in range(8)], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))"
    kept = lambda *states: ", ".join(f"CASE WHEN fits AND initial = '{i}' THEN {keep(v)} END" for v, i in states)
    roled = lambda name, *states: ", ".join(f"CASE WHEN fits THEN {rerole(v, name)} END" for v in states)
    return f"""
        WITH RECURSIVE marked AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS mark FROM conversations
        ), checked AS (
            SELECT *, xor({crc}, 4294967295) % 20 AS way FROM marked
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
                CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE way WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM checked
        ), placed AS (
            SELECT *, rtrim(text, {_SPACES}) AS ends, row_number() OVER w AS p, row_number() OVER (
                PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before
            FROM damaged WINDOW w AS (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(concat_ws(':', coalesce(CAST(conv_id AS VARCHAR), ' '), length(role), role, text)), copy)
        ), faulty AS (
            SELECT *, ends = '' AS blank, ends <> '' AND again AS duplicate, ends <> '' AND NOT again AND right(ends, 1) NOT IN ('.', '!', '?') AS truncated FROM placed
        ), counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
                count(*) FILTER (truncated) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM faulty GROUP BY conv_id
        ), steps AS (
            SELECT conv_id, 0::BIGINT AS p, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS s1,
                NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS s3
            FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, p + 1, {delete('s0')}, {_least(delete('s1'), kept(('s0', 's')))},
                {_least(delete('u'), kept(('s0', 'u'), ('s1', 'u'), ('a', 'u')), roled('user', 's0', 's1', 'a'))},
                {_least(delete('a'), kept(('u', 'a')), roled('assistant', 'u'))}
            FROM (
                SELECT *, {_least('s3', insert('u', 'assistant'))} AS a FROM (
                    SELECT s.conv_id, s.p, s.s0, s.s1, s.s3, {u} AS u, f.role, f.text, f.initial, NOT (f.blank OR f.duplicate) AS fits, CASE WHEN f.truncated THEN 3 ELSE 0 END AS late
                    FROM steps s JOIN faulty f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.p = s.p + 1
                )
            )
        ), ended AS (
            SELECT conv_id, {_least('s0', 's3', insert('u', 'assistant'))} AS best FROM (
                SELECT s.conv_id, s0, s3, {u} AS u FROM steps s LEFT JOIN counted c ON s.conv_id IS NOT DISTINCT FROM c.conv_id WHERE s.p = coalesce(c.n, 0)
            )
        )
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
        FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    """


def centroid_clusters(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """Every round compares all vectors with all centroids, in whole numbers."""
    ctes = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: greatest(least(floor(1024 * CAST(x AS DOUBLE)), 134217728), -134217728)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS cluster, v AS c FROM kept ORDER BY cluster LIMIT {k})",
    ]
    for t in range(rounds + 1):
        ctes.append(f"""a{t} AS MATERIALIZED (
            SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'cluster': cluster}}) AS best FROM (
                SELECT row, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{t}
            ) GROUP BY row
        )""")
        if t < rounds:
            ctes.append(f"""c{t + 1} AS MATERIALIZED (
                SELECT c{t}.cluster, coalesce(moved.c, c{t}.c) AS c FROM c{t} LEFT JOIN (
                    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM (
                        SELECT best.cluster AS cluster, pos, sum(v[pos])::BIGINT AS s, count(*) AS n FROM a{t}, (SELECT unnest(range(1, {size + 1})) AS pos) GROUP BY ALL
                    ) GROUP BY cluster
                ) moved USING (cluster)
            )""")
    return f"""WITH {', '.join(ctes)}
        SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
            CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON best.cluster = c{rounds}.cluster
    """


MIXES = r"""
    WITH sized AS (
        SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
    ), placed AS (
        SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY doc_id, size, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized
    ), sizes AS (
        SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM placed GROUP BY source
    ), weighed AS (
        SELECT *, [3, 1, 2][number % 3 + 1] AS weight, 2 * source_size AS most FROM sizes
    ), levels AS (
        SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER r, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS level FROM weighed
        WINDOW r AS (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), targets AS (
        SELECT source, number, source_size, least(most::DOUBLE, weight * (
            SELECT min_by(level, {'r': most / weight, 'n': number}) FROM levels WHERE level <= most / weight)) AS target FROM levels
    ), wanted AS (
        SELECT *, least(floor(target + 0.5)::BIGINT, 2 * source_size) AS words, (source_size + 1023) // 1024 AS n FROM targets
    ), blocks AS (
        SELECT number, n, epoch, unnest(range(n)) AS block, CASE epoch WHEN 0 THEN least(words, source_size) ELSE words - source_size END AS want
        FROM wanted, (SELECT unnest([0, 1]) AS epoch) WHERE words > epoch * source_size
    ), drawn AS (
        SELECT *, least(1024, want - 1024 * (row_number() OVER (PARTITION BY number, epoch ORDER BY block = n - 1, md5(concat_ws(':', 0, number, epoch, block))) - 1)) AS most FROM blocks
    ), found AS (
        SELECT p.*, w.number, w.source_size, w.target FROM placed p JOIN wanted w ON p.source IS NOT DISTINCT FROM w.source
    ), taken AS (
        SELECT f.row, sum(least(f.start + f.size, d.block * 1024 + d.most) - greatest(f.start, d.block * 1024))::BIGINT AS taken
        FROM found f JOIN drawn d ON f.number = d.number AND d.most > 0 AND f.start < d.block * 1024 + d.most AND f.start + f.size > d.block * 1024 GROUP BY f.row
    )
    SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM found LEFT JOIN taken USING (row)
"""
