"""DuckDB SQL of the dialogue plan, as common table expressions that the oracles build on."""

from __future__ import annotations

WORDS = r"""
turns AS (
    SELECT conv_id::VARCHAR AS dialogue_id, turn, CASE role WHEN 'assistant' THEN 'A' ELSE 'B' END AS speaker,
        list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda w: w <> '') AS ws
    FROM conversations WHERE role IN ('assistant', 'user') AND text IS NOT NULL
), counted AS (
    SELECT *, coalesce(sum(len(ws)) OVER (PARTITION BY dialogue_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM turns WHERE len(ws) > 0
), words AS (
    SELECT dialogue_id, speaker, word, pos, pos * 0.11::DOUBLE AS start, pos * 0.11::DOUBLE + 0.09::DOUBLE AS "end"
    FROM (SELECT dialogue_id, speaker, unnest(ws) AS word, (before + generate_subscripts(ws, 1) - 1)::INTEGER AS pos FROM counted)
), judged AS (
    SELECT dialogue_id, count(DISTINCT speaker) = 2 AS good FROM words GROUP BY 1
), spaced AS (
    SELECT *, sum(len(text)) OVER (PARTITION BY dialogue_id, speaker ORDER BY n)::BIGINT AS c1
    FROM (
        SELECT *, CASE WHEN n > 0 THEN ' ' || word ELSE word END AS text
        FROM (SELECT w.*, row_number() OVER (PARTITION BY w.dialogue_id, w.speaker ORDER BY start, pos) - 1 AS n FROM words w JOIN judged USING (dialogue_id) WHERE good)
    )
)"""

TOKENS = (
    WORDS
    + r""", pieces AS (
    SELECT *, substring(text, j * 3 + 1, 3) AS token FROM (SELECT *, unnest(range(0, ceil(len(text) / 3.0)::INTEGER)) AS j FROM spaced)
), aligned AS (
    SELECT dialogue_id, speaker, (row_number() OVER (PARTITION BY dialogue_id, speaker ORDER BY n, j) - 1)::INTEGER AS token_idx,
        (('0x' || substr(md5(token), 1, 6))::BIGINT % 31000 + 4)::INTEGER AS token_id,
        start + (j * 3) * (("end" - start) / len(text)) AS t0,
        start + (j * 3 + len(token) - 1 + 1) * (("end" - start) / len(text)) AS t1
    FROM pieces
), framed AS (
    SELECT *, round((t0 - t0 % (1 / 12.5::DOUBLE)) / (1 / 12.5::DOUBLE))::INTEGER AS frame,
        trunc((last_value(t1) OVER (PARTITION BY dialogue_id, speaker ORDER BY token_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + 1) * 12.5)::INTEGER AS num_frames
    FROM aligned
), slots AS (
    SELECT *, token_idx + max(frame - token_idx) OVER (PARTITION BY dialogue_id, speaker ORDER BY token_idx) AS slot FROM framed
), placed AS (
    SELECT *, lag(slot) OVER (PARTITION BY dialogue_id, speaker ORDER BY slot) AS earlier FROM slots WHERE slot < num_frames
), cells AS (
    SELECT dialogue_id, speaker, num_frames, slot, token_id AS id FROM placed
    UNION ALL
    SELECT dialogue_id, speaker, num_frames, slot - 1, 0 FROM placed WHERE slot > 0 AND (earlier IS NULL OR earlier <> slot - 1)
)"""
)

STREAMS = (
    TOKENS
    + r""", sizes AS (SELECT dialogue_id, speaker, max(num_frames) AS num_frames FROM cells GROUP BY ALL),
grid AS (
    SELECT dialogue_id, speaker, list(coalesce(id, 3) ORDER BY f) AS text
    FROM (SELECT *, unnest(range(0, num_frames)) AS f FROM sizes) LEFT JOIN (SELECT dialogue_id, speaker, slot AS f, id FROM cells) USING (dialogue_id, speaker, f)
    GROUP BY ALL
)"""
)

MERGED = (
    STREAMS
    + r""", lengths AS (
    SELECT dialogue_id, greatest(max(len(text)) - (dialogue_id::BIGINT % 3) * 5, 1) AS frames FROM grid GROUP BY 1
), merged AS (
    SELECT dialogue_id, speaker, 0 AS k, list_resize(list_slice(text, 1, frames), frames, 3)::BIGINT[] AS s FROM grid JOIN lengths USING (dialogue_id)
    UNION ALL
    SELECT dialogue_id, speaker, k + 1, list_transform(range(0, frames), lambda t: (dialogue_id::BIGINT * 31 + (CASE speaker WHEN 'B' THEN 5 ELSE 0 END) + k * 17 + t * 7) % 2048)
    FROM grid JOIN lengths USING (dialogue_id), (SELECT unnest(range(0, 8)) AS k)
), viewed AS (
    SELECT dialogue_id, speaker, k, s FROM merged
    UNION ALL
    SELECT dialogue_id, CASE speaker WHEN 'A' THEN 'B' ELSE 'A' END, k + 8, s FROM merged WHERE k > 0
), ids AS (
    SELECT *, CASE k WHEN 0 THEN 32000 ELSE 2048 END AS ini, CASE k WHEN 0 THEN 3 ELSE 2048 END AS pad, CASE WHEN k IN (0, 1, 9) THEN 0 ELSE 1 END AS late FROM viewed
), delayed AS (
    SELECT dialogue_id, speaker, k, ini, late, list_concat(list_concat(list_resize([]::BIGINT[], late + 1, ini), s), list_resize([]::BIGINT[], 1 - late, pad)) AS s FROM ids
), counts AS (
    SELECT *, len(s) AS n, ceil(len(s) / 64.0)::BIGINT AS parts FROM delayed
), pieced AS (
    SELECT *, n // parts + (chunk < n % parts)::BIGINT AS num_frames, chunk * (n // parts) + least(chunk, n % parts) AS off FROM (SELECT *, unnest(range(0, parts)) AS chunk FROM counts)
), chunks AS (
    SELECT dialogue_id, speaker, k, ini, chunk::INTEGER AS chunk, num_frames::INTEGER AS num_frames, list_slice(s, off + 1, off + num_frames) AS s FROM pieced
), examples AS (
    SELECT *, list_transform(s, lambda v: CASE WHEN v < ini THEN v ELSE -1 END) AS labels, dense_rank() OVER (ORDER BY dialogue_id, speaker, chunk) - 1 AS example_id FROM chunks WHERE num_frames >= 16
), padded AS (
    SELECT *, list_resize(s, most, -1::BIGINT) AS input_ids, list_resize(labels, most, -1::BIGINT) AS out_labels FROM (SELECT *, example_id // 4 AS batch_id, max(num_frames) OVER (PARTITION BY example_id // 4) AS most FROM examples)
)"""
)


def check(values: str) -> str:
    """The checksum of an array: value times 1-based position."""
    return f"coalesce(list_sum(list_transform({values}, lambda v, i: v * i)), 0)::BIGINT"


def over(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"
