"""Queries that cost fields and documents under two real vocabularies."""

from __future__ import annotations

import os

from cohortry.operators import token_costs as tc
from cohortry.plans import fixtures as fx
from cohortry.plans import text_plans as tp

# Where the vocabulary files are.
FOLDER = os.environ.get("COHORTRY_VOCABULARIES", "/opt/tokenizers")
SPACED, ENDED = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/word_bpe_49k.json"


def vocabularies(spark):
    return [tc.spaced_vocabulary(spark, "spaced", tc.read_pieces(SPACED)),
            tc.ended_vocabulary(spark, "ended", tc.read_pieces(ENDED))]


def field_piece_cost(spark, sf_dir):
    """The worst cost of each field over all development rows and both vocabularies."""
    return tc.field_costs(tp._train(spark, sf_dir), tp.LABELS, vocabularies(spark), tp.MASK)


def piece_truncation(spark, sf_dir):
    """Whole documents against the window, by language and vocabulary."""
    return tc.truncation_audit(fx.table(spark, sf_dir, "documents"), ["lang"], vocabularies(spark))


QUERIES = {f.__name__: f for f in (field_piece_cost, piece_truncation)}


def _walk_sql(v: str, path: str, mark: str, pattern: str, lower: bool) -> str:
    """CTEs that cost the rows of ``texts`` (text): {v}_text (text, cost)."""
    text = "lower(text)" if lower else "text"
    at_end = f"ends_with(k, '{mark}')" if lower else "NULL::BOOLEAN"
    piece = f"CASE WHEN ends_with(k, '{mark}') THEN left(k, length(k) - {len(mark)}) ELSE k END" \
        if lower else f"replace(k, '{mark}', ' ')"
    return f"""
{v}_keys AS (SELECT unnest(json_keys(content::JSON, '$.model.vocab')) AS k
  FROM read_text('{path}')),
{v}_pieces AS (SELECT DISTINCT {piece} AS piece, {at_end} AS at_end FROM {v}_keys
  WHERE regexp_full_match({piece}, '[\\x00-\\x7F]+')),
{v}_held AS (SELECT text, unnest(regexp_extract_all({text}, '{pattern}')) AS word FROM texts),
{v}_words AS (SELECT DISTINCT word, length(word)::INTEGER AS size FROM {v}_held),
{v}_spots AS (SELECT word, size, unnest(range(1, size + 1))::INTEGER AS pos FROM {v}_words),
{v}_subs AS (SELECT word, size, pos, unnest(range(1, size - pos + 2))::INTEGER AS len FROM {v}_spots),
{v}_match AS (SELECT word, pos, max(len) AS len FROM {v}_subs JOIN {v}_pieces
  ON piece = substr(word, pos, len) AND (at_end IS NULL OR at_end = (pos + len - 1 = size))
  GROUP BY word, pos),
{v}_walk(word, size, pos, cost) AS (SELECT word, size, 1, 0::BIGINT FROM {v}_words
  UNION ALL SELECT w.word, w.size, w.pos + coalesce(m.len, 1),
    w.cost + CASE WHEN m.len IS NULL THEN strlen(substr(w.word, w.pos, 1)) ELSE 1 END
  FROM {v}_walk w LEFT JOIN {v}_match m ON m.word = w.word AND m.pos = w.pos WHERE w.pos <= w.size),
{v}_cost AS (SELECT word, cost FROM {v}_walk WHERE pos > size),
{v}_text AS (SELECT t.text, coalesce(c.cost, 0)::BIGINT AS cost FROM texts t LEFT JOIN (
  SELECT text, sum(cost) AS cost FROM {v}_held JOIN {v}_cost USING (word) GROUP BY text) c
  ON c.text = t.text)"""


_BOTH = ",".join((_walk_sql("spaced", SPACED, tc.SPACE_MARK, tc.SPACED_WORDS, False),
                  _walk_sql("ended", ENDED, tc.END_MARK, tc.LOWER_WORDS, True)))
_STACKED = "stacked AS (" + " UNION ".join(
    f"SELECT {i} AS pos, '{c}' AS \"column\", {tp.field_sql(c)} || ', ' AS text FROM clean"
    f" WHERE split = 'train'" for i, c in enumerate(tp.LABELS)) + ")"

ORACLE = {
    "field_piece_cost": f"""WITH RECURSIVE {tp.C}, {_STACKED},
texts AS (SELECT DISTINCT text FROM stacked), {_BOTH}
SELECT pos, "column", max(greatest(s.cost, e.cost))::INTEGER AS cost
FROM stacked JOIN spaced_text s USING (text) JOIN ended_text e USING (text) GROUP BY ALL""",
    "piece_truncation": f"""WITH RECURSIVE
texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), {_BOTH},
each AS (SELECT *, 'spaced' AS vocabulary FROM spaced_text
  UNION ALL SELECT *, 'ended' FROM ended_text),
n AS (SELECT lang, v.vocabulary, coalesce(e.cost, 0) + 2 AS tokens
  FROM documents d CROSS JOIN (VALUES ('spaced'), ('ended')) v(vocabulary)
  LEFT JOIN each e ON e.text = d.text AND e.vocabulary = v.vocabulary)
SELECT lang, vocabulary, count(*) AS n_chunks, max(tokens)::BIGINT AS longest,
  count(*) FILTER (tokens > 512) AS n_over, (512 - max(tokens))::BIGINT AS headroom
FROM n GROUP BY ALL""",
}
