"""DuckDB CTE bodies for the fixture views (mirror ``quire.tables``)."""

from __future__ import annotations

from quire.functions.text import EDGE_WS_RE, THINK_RE, WORD_RE, WS_BODY
from quire.sources import literals as L

WORD = WORD_RE
EDGE = EDGE_WS_RE

PROMPTS = """prompts AS (
  SELECT conv_id * 4294967296 + turn AS prompt_id, conv_id, turn,
         'd' || CAST(conv_id % 9 AS VARCHAR) AS domain, text AS prompt
  FROM conversations WHERE role = 'user')"""

RESPONSES = """responses AS (
  SELECT a.conv_id, a.turn,
         CASE WHEN a.conv_id % 2 = 0 THEN 'A' ELSE 'B' END AS model,
         a.conv_id * 4294967296 + a.turn - 1 AS prompt_id,
         CAST(((a.conv_id // 2) + (a.turn // 2)) % 14 AS INTEGER) AS test_ord,
         u.text AS prompt, a.text AS text
  FROM conversations a JOIN conversations u
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE a.role = 'assistant' AND u.role = 'user')"""

RUNS = """runs AS (
  SELECT event_id AS run_id, ts,
         CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS model,
         event_type AS suite,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS tokens,
         CASE WHEN event_id % 97 = 0 THEN 0.0 ELSE value END AS elapsed,
         CASE WHEN event_id % 89 = 0 THEN NULL
              WHEN event_id % 89 = 1 THEN 0
              ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS eval_count,
         CASE WHEN event_id % 83 = 0 THEN NULL
              ELSE CAST(round(value * 1e9) AS BIGINT) END AS duration_ns,
         CAST(json_extract_string(props, '$.k') AS INTEGER) >= 25 AS passed
  FROM events)"""

VECTORS = """vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"""

MODULE_LIST = "['q_proj','k_proj','v_proj','o_proj','up_proj','gate_proj','down_proj','norm']"

SEGMENTS = f"""segments AS (
  SELECT vec_id, v, label,
         'model.layers.' || CAST(label AS VARCHAR) || '.' || {MODULE_LIST}[(vec_id % 8) + 1] AS path,
         {MODULE_LIST}[(vec_id % 8) + 1] AS module
  FROM vectors)"""

RULES = f"""rules AS (
  SELECT * FROM (VALUES
{L.sql_values_rules()}
  ) t({L.RULE_COLUMNS}))"""


def words(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{WORD}')"


def word_count(expr: str) -> str:
    return f"CAST(len({words(expr)}) AS BIGINT)"


def py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '{EDGE}', '', 'g')"


def strip_think(expr: str, lenient: bool = False) -> str:
    out = f"regexp_replace({expr}, '{THINK_RE}', '', 'g')"
    if lenient:
        out = f"regexp_replace({out}, '(?s)^.*?</think>', '')"
    return py_strip(out)


def md5_int(expr: str, digits: int = 7) -> str:
    return f"('0x' || substr(md5({expr}), 1, {digits}))::BIGINT"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def q(s: str) -> str:
    """SQL string literal (real newlines kept)."""
    return "'" + s.replace("'", "''") + "'"


TEMPS = """temps AS (
  SELECT CAST(i - 1 AS INTEGER) AS temp_idx,
         CAST(string_split('0.2,0.4,0.6', ',')[i] AS DOUBLE) AS temperature
  FROM range(1, 4) r(i))"""

RANKED = """ranked AS (
  SELECT prompt_id, prompt, md5('42:' || CAST(prompt_id AS VARCHAR)) AS shuffle_key,
         row_number() OVER (ORDER BY md5('42:' || CAST(prompt_id AS VARCHAR)), prompt_id) AS shuffle_rank,
         count(*) OVER () AS n_prompts
  FROM prompts),
split AS (
  SELECT *, CASE WHEN shuffle_rank - 1 < floor(n_prompts * 0.85::DOUBLE) THEN 'train' ELSE 'valid' END AS split
  FROM ranked),
plan AS (
  SELECT s.*, t.temp_idx, t.temperature FROM split s, temps t)"""
