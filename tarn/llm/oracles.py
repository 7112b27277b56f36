"""DuckDB SQL for the queries of the operators whose results SQL can express, by the plainest way to them."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"

OP5 = rf"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents
    ), parts AS (
        SELECT *, regexp_extract_all(text, {_WORD}) AS words,
               list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines
        FROM docs
    ), windows AS (
        SELECT r, i, words[i : i + 7] AS win FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM parts)
    ), repeats AS (
        SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1
    ), covered AS (
        SELECT r, count(DISTINCT i + k) AS n FROM repeats, range(8) AS steps(k) GROUP BY r
    ), lines AS (
        SELECT r, host, text,
               lower(trim(regexp_replace(regexp_replace(line, '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS line
        FROM (SELECT r, host, text, unnest(lines) AS line FROM parts)
    ), hosts AS (
        SELECT host, count(DISTINCT text) AS documents FROM docs GROUP BY host
    ), frequent AS (
        SELECT host, line, count(DISTINCT text) AS n FROM lines GROUP BY host, line
    ), above AS (
        SELECT f.host, f.line FROM frequent f JOIN hosts h ON f.host IS NOT DISTINCT FROM h.host
        WHERE n > 10 AND n > least(0.08::DOUBLE * documents, 100)
    ), lost AS (
        SELECT r, sum(len(regexp_extract_all(l.line, {_WORD}))) AS n
        FROM lines l JOIN above a ON l.host IS NOT DISTINCT FROM a.host AND l.line = a.line GROUP BY r
    ), measured AS (
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
               CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
               CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
               CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
               CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
        FROM parts LEFT JOIN covered USING (r) LEFT JOIN lost USING (r)
    ), judged AS (
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
    )
    SELECT *, NOT base_failed AND n_words - n_removed_words >= 0.3::DOUBLE * n_words AS kept FROM judged
"""

OP6 = rf"""
    WITH RECURSIVE docs AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w
        FROM documents
    ), sets AS (
        SELECT r, doc_id, CASE WHEN len(w) BETWEEN 1 AND 2 THEN [array_to_string(w, ' ')]
            ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s
        FROM docs
    ), classes AS (
        SELECT s, min(r) AS cls, min(doc_id) AS first, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
    ), shingles AS (
        SELECT cls, n, unnest(s) AS shingle FROM classes
    ), pairs AS (
        SELECT a.cls AS a, b.cls AS b, count(*) AS i, any_value(a.n + b.n) AS t
        FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.cls < b.cls GROUP BY a.cls, b.cls
    ), links AS (
        SELECT a, b FROM pairs WHERE 100 * i >= 85 * (t - i) UNION ALL SELECT b, a FROM pairs WHERE 100 * i >= 85 * (t - i)
    ), reached AS (
        SELECT cls AS a, cls AS b FROM classes UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
    ), components AS (
        SELECT a AS cls, min(first) AS component FROM reached JOIN classes ON classes.cls = reached.b GROUP BY a
    ), placed AS (
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE component END AS component_id
        FROM sets s LEFT JOIN classes USING (s) LEFT JOIN components USING (cls)
    )
    SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM placed
"""

# The five primes of the published xxHash64, the seed of Spark's xxhash64, the multiplier of the published
# jump consistent hash, and the polynomial of CRC-32.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_SEED = 42
_MULTIPLIER = 2862933555777941757
_POLYNOMIAL = 0xEDB88320
_2_64 = "18446744073709551616::UHUGEINT"


def _product(x: str, y: int) -> str:
    return f"({x} * {y}::UHUGEINT % {_2_64})"


def _rotated(x: str, by: int) -> str:
    return f"(({x} << {by}) % {_2_64} + ({x} >> {64 - by}))"


def _final(x: str, name: str) -> str:
    """Columns that end a hash of xxHash64; the last has the name."""
    return f"""xor({x}, {x} >> 33) AS {name}_1, {_product(f"{name}_1", _P2)} AS {name}_2, xor({name}_2, {name}_2 >> 29) AS {name}_3,
               {_product(f"{name}_3", _P3)} AS {name}_4, xor({name}_4, {name}_4 >> 32) AS {name}"""


OP7 = f"""
    WITH RECURSIVE remainders AS (
        SELECT list_transform(range(256), lambda b: list_reduce(range(8),
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor({_POLYNOMIAL}, c >> 1) ELSE c >> 1 END, b)) AS crc
    ), docs AS (
        SELECT doc_id, coalesce(text, '') AS text FROM documents
    ), summed AS (
        SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size,
               xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: CAST('0x' || p AS BIGINT)),
                   lambda c, byte: xor(c >> 8, crc[(xor(c, byte) & 255) + 1]), 4294967295)) AS text_crc32
        FROM docs, remainders
    ), flagged AS (
        SELECT DISTINCT doc_id, xor({_SEED + _P5 + 4}::UHUGEINT % {_2_64}, CASE WHEN doc_id IS NULL THEN {_P1} ELSE 0 END::UHUGEINT) AS f_0,
               ({_product(_rotated("f_0", 23), _P2)} + {_P3}::UHUGEINT) % {_2_64} AS f_5,
               {_final("f_5", "flag")}
        FROM docs
    ), hashed AS (
        SELECT doc_id, flag, ((doc_id::HUGEINT + 18446744073709551616) % 18446744073709551616)::UHUGEINT AS id,
               {_product("id", _P2)} AS k_0, {_product(_rotated("k_0", 31), _P1)} AS k_1,
               xor((flag + {_P5 + 8}::UHUGEINT) % {_2_64}, k_1) AS k_2,
               ({_product(_rotated("k_2", 27), _P1)} + {_P4}::UHUGEINT) % {_2_64} AS k_3,
               {_final("k_3", "hash")}
        FROM flagged
    ), jumps AS (
        SELECT doc_id, coalesce(hash, flag) AS key, -1::BIGINT AS b, 0::BIGINT AS j FROM hashed
        UNION ALL
        SELECT doc_id, next, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((next >> 33) + 1)::DOUBLE))::BIGINT
        FROM (SELECT *, ({_product("key", _MULTIPLIER)} + 1::UHUGEINT) % {_2_64} AS next FROM jumps WHERE j < 9)
    ), shards AS (
        SELECT doc_id, CAST(max(b) FILTER (b < 8) AS INTEGER) AS shard, CAST(max(b) AS INTEGER) AS grown_shard FROM jumps GROUP BY doc_id
    )
    SELECT s.doc_id, size, text_crc32, 'key' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY s.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
    FROM summed s JOIN shards ON s.doc_id IS NOT DISTINCT FROM shards.doc_id
"""
