"""DuckDB twins of the registered queries (run on the same Parquet views).

Each string uses the fixture CTEs of ``fixtures_sql`` and aliases every column to
the same name as the Spark query.
"""

from __future__ import annotations

import math

from quire.plans import fixtures_sql as X

ORACLES: dict[str, str] = {}


def oracle(name: str):
    def deco(fn):
        ORACLES[name] = fn()
        return fn
    return deco


# ---------------------------------------------------------------- grading
GRADED = X.RESPONSES + """,
""" + X.RULES + f""",
checked AS (
  SELECT r.conv_id, r.turn, r.model, r.prompt_id, r.text,
         ru.rule_set, ru.suite, ru.test, ru.test_ord, ru.clause_id,
         bool_or(contains(
            CASE WHEN ru.prefix_chars IS NULL THEN h.hay ELSE left(h.hay, ru.prefix_chars) END,
            ru.needle)) AS clause_ok
  FROM responses r JOIN rules ru ON r.test_ord = ru.test_ord,
  LATERAL (SELECT CASE WHEN ru.ignore_case THEN lower(
                    CASE WHEN ru.strip_think THEN {X.strip_think('r.text')} ELSE r.text END)
                  ELSE CASE WHEN ru.strip_think THEN {X.strip_think('r.text')} ELSE r.text END
                  END AS hay) h
  GROUP BY ALL),
graded AS (
  SELECT conv_id, turn, model, prompt_id, text, rule_set, suite, test, test_ord,
         bool_and(clause_ok) AS ok
  FROM checked GROUP BY conv_id, turn, model, prompt_id, text, rule_set, suite, test, test_ord)
"""


@oracle("grade_responses")
def _():
    return "WITH " + GRADED + """
SELECT rule_set, model, suite, test, test_ord, conv_id, turn, prompt_id, ok,
       CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status
FROM graded"""


@oracle("suite_score")
def _():
    return "WITH " + GRADED + """
SELECT rule_set, model, suite, CAST(count_if(ok) AS BIGINT) AS passed,
       CAST(count(*) AS BIGINT) AS total,
       round(100.0 * count_if(ok) / count(*), 6) AS score
FROM graded GROUP BY rule_set, model, suite"""


ORACLES["stream_suite_score"] = ORACLES["suite_score"]


@oracle("failure_report")
def _():
    return "WITH " + GRADED + """
SELECT rule_set, model, suite, test, prompt_id, left(text, 150) AS preview,
       CAST(greatest(length(text) - 150, 0) AS BIGINT) AS more_chars
FROM graded WHERE NOT ok"""


@oracle("rule_catalog")
def _():
    return X.with_(X.RESPONSES, X.RULES) + f"""
SELECT ru.rule_set, ru.strip_think, ru.test_ord, ru.suite, ru.test, ru.clause_id, ru.needle,
       ru.ignore_case, ru.prefix_chars,
       CAST(count(*) AS BIGINT) AS n_responses,
       CAST(count_if(contains(
          CASE WHEN ru.prefix_chars IS NULL THEN h.hay ELSE left(h.hay, ru.prefix_chars) END,
          ru.needle)) AS BIGINT) AS hits
FROM responses r JOIN rules ru ON r.test_ord = ru.test_ord,
LATERAL (SELECT CASE WHEN ru.ignore_case THEN lower(
                  CASE WHEN ru.strip_think THEN {X.strip_think('r.text')} ELSE r.text END)
                ELSE CASE WHEN ru.strip_think THEN {X.strip_think('r.text')} ELSE r.text END
                END AS hay) h
GROUP BY ALL"""


# ---------------------------------------------------------------- scoreboard
@oracle("word_counts")
def _():
    return f"""SELECT doc_id, lang, {X.word_count('text')} AS n_words,
       CAST(length(text) AS BIGINT) AS n_chars FROM documents"""


@oracle("token_fallback")
def _():
    return X.with_(X.RESPONSES) + f"""
, b AS (
  SELECT conv_id, turn, {X.word_count('text')} AS n_words,
         CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN CAST(0 AS BIGINT)
              ELSE CAST(length(text) // 4 AS BIGINT) END AS reported
  FROM responses)
SELECT conv_id, turn, n_words, reported,
       coalesce(reported, CAST(floor(n_words * 1.3::DOUBLE) AS BIGINT)) AS tokens_missing_fallback,
       coalesce(nullif(reported, 0), n_words) AS tokens_falsy_fallback
FROM b"""


RATE = "CASE WHEN elapsed > 0 THEN tokens / elapsed ELSE 0.0 END"


@oracle("speed_mean_of_rates")
def _():
    return X.with_(X.RUNS) + f"""
SELECT model, suite, CAST(count(*) AS BIGINT) AS n_runs,
       round(avg({RATE}), 6) AS mean_tps,
       round(avg(CASE WHEN duration_ns > 0
                      THEN coalesce(nullif(eval_count, 0), tokens) / (duration_ns / 1e9) END), 6) AS mean_tps_ns,
       round(avg(coalesce(nullif(eval_count, 0), tokens)
                 / (coalesce(nullif(duration_ns, 0), 1) / 1e9)), 0) AS mean_tps_or1
FROM runs GROUP BY model, suite"""


@oracle("speed_ratio_of_sums")
def _():
    return X.with_(X.RUNS) + """
SELECT model, suite, CAST(sum(tokens) AS BIGINT) AS sum_tokens, round(sum(elapsed), 6) AS sum_elapsed,
       round(CASE WHEN sum(elapsed) > 0 THEN sum(tokens) / sum(elapsed) ELSE 0.0 END, 6) AS avg_tps
FROM runs GROUP BY model, suite"""


RUN_SCORES = f"""run_scores AS (
  SELECT model, suite, CAST(count_if(passed) AS BIGINT) AS passed, CAST(count(*) AS BIGINT) AS total,
         round(100.0 * count_if(passed) / count(*), 6) AS score,
         round(CASE WHEN sum(elapsed) > 0 THEN sum(tokens) / sum(elapsed) ELSE 0.0 END, 6) AS avg_tps,
         round(avg({RATE}), 6) AS mean_tps
  FROM runs GROUP BY model, suite)"""


@oracle("head_to_head")
def _():
    return X.with_(X.RUNS) + """
, g AS (
  SELECT suite,
         CAST(count_if(model = 'A' AND passed) AS BIGINT) AS a_passed,
         CAST(count_if(model = 'A') AS BIGINT) AS a_total,
         sum(CASE WHEN model = 'A' THEN tokens END) AS a_tok, sum(CASE WHEN model = 'A' THEN elapsed END) AS a_el,
         CAST(count_if(model = 'B' AND passed) AS BIGINT) AS b_passed,
         CAST(count_if(model = 'B') AS BIGINT) AS b_total,
         sum(CASE WHEN model = 'B' THEN tokens END) AS b_tok, sum(CASE WHEN model = 'B' THEN elapsed END) AS b_el
  FROM runs WHERE model IN ('A', 'B') GROUP BY suite
  HAVING count_if(model = 'A') > 0 AND count_if(model = 'B') > 0),
h AS (
  SELECT *, 100.0 * a_passed / a_total AS a_s, 100.0 * b_passed / b_total AS b_s,
         CASE WHEN a_el > 0 THEN a_tok / a_el ELSE 0.0 END AS a_t,
         CASE WHEN b_el > 0 THEN b_tok / b_el ELSE 0.0 END AS b_t
  FROM g)
SELECT suite, a_passed, a_total, round(a_s, 6) AS a_score, round(a_t, 6) AS a_tps,
       b_passed, b_total, round(b_s, 6) AS b_score, round(b_t, 6) AS b_tps,
       round(a_s - b_s, 6) AS gap,
       round(CASE WHEN b_t > 0 THEN a_t / b_t ELSE 0.0 END, 6) AS speed_ratio
FROM h"""


@oracle("common_suites")
def _():
    return X.with_(X.RUNS) + """
SELECT suite FROM runs WHERE model = 'A' INTERSECT SELECT suite FROM runs WHERE model = 'B'"""


@oracle("resolve_model")
def _():
    return X.with_(X.RUNS) + """
, labels AS (SELECT model || '_' || suite AS label, min(run_id) AS first_seen FROM runs GROUP BY 1),
cand AS (
  SELECT label, first_seen, pattern
  FROM labels, (SELECT unnest(['A_', 'B_', '_view', 'click', 'zzz']) AS pattern) p
  WHERE contains(label, pattern))
SELECT pattern, arg_min(label, first_seen) AS resolved, CAST(count(*) AS BIGINT) AS n_candidates
FROM cand GROUP BY pattern"""


@oracle("summary_pivot")
def _():
    return X.with_(X.RUNS) + """
SELECT model, suite, round(100.0 * count_if(passed) / count(*), 6) AS score
FROM runs GROUP BY model, suite"""


@oracle("run_delta")
def _():
    return X.with_(X.RUNS) + """
, l AS (SELECT run_id, model, suite, elapsed,
               lag(elapsed) OVER (PARTITION BY model, suite ORDER BY run_id) AS prev
        FROM runs)
SELECT run_id, model, suite, round(elapsed, 6) AS elapsed, round(prev, 6) AS prev_elapsed,
       round(elapsed - prev, 6) AS delta FROM l"""


@oracle("response_preview")
def _():
    return X.with_(X.RESPONSES) + """
SELECT conv_id, turn, left(prompt, 60) AS prompt_60, left(prompt, 80) AS prompt_80,
       left(text, 150) AS text_150, left(text, 200) AS text_200,
       left(text, 400) AS text_400, CAST(greatest(length(text) - 400, 0) AS BIGINT) AS more_400,
       left(text, 500) AS text_500, CAST(greatest(length(text) - 500, 0) AS BIGINT) AS more_500,
       CASE WHEN length(text) > 400
            THEN '   ... [' || CAST(length(text) - 400 AS VARCHAR) || ' more chars]' END AS remainder_note
FROM responses"""


@oracle("quality_samples")
def _():
    return X.with_(X.RESPONSES) + """
, t AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY prompt_id) AS ord,
               text, length(text) AS n_chars FROM responses)
SELECT model, CAST(count(*) AS BIGINT) AS n_samples,
       string_agg(text, ' || ' ORDER BY ord) AS samples, CAST(sum(n_chars) AS BIGINT) AS sample_chars
FROM t WHERE ord <= 3 GROUP BY model"""


@oracle("suite_filter")
def _():
    return X.with_(X.RUNS) + """
SELECT run_id, model, suite, tokens, round(elapsed, 6) AS elapsed FROM runs
WHERE suite IN ('click', 'view')"""


@oracle("model_filter")
def _():
    return X.with_(X.RUNS) + """
SELECT model, suite, CAST(count(*) AS BIGINT) AS n_runs, CAST(count_if(passed) AS BIGINT) AS passed
FROM runs WHERE model = 'A' GROUP BY model, suite"""


@oracle("result_json")
def _():
    return X.with_(X.RUNS, RUN_SCORES) + """
SELECT model, suite, score, passed, total, avg_tps FROM run_scores"""


@oracle("result_json_filtered")
def _():
    return X.with_(X.RUNS, RUN_SCORES) + """
SELECT model, suite AS key, 'dict' AS kind, score, passed, total, avg_tps, CAST(NULL AS DOUBLE) AS value
FROM run_scores
UNION ALL
SELECT model, 'avg_speed', 'number', CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT),
       CAST(NULL AS DOUBLE), round(avg(mean_tps), 6)
FROM run_scores GROUP BY model"""


# ---------------------------------------------------------------- data production
CHAT_USER = X.q("<|im_start|>user\n")
CHAT_MID = X.q("<|im_end|>\n<|im_start|>assistant\n")


@oracle("chat_prompt")
def _():
    return X.with_(X.PROMPTS) + f"""
SELECT prompt_id, {CHAT_USER} || prompt || {CHAT_MID} AS chat,
       CAST(length({CHAT_USER} || prompt || {CHAT_MID}) AS BIGINT) AS n_chars
FROM prompts"""


EXAMPLE = f"{CHAT_USER} || prompt || {CHAT_MID} || text || '<|im_end|>'"


@oracle("chat_example")
def _():
    return X.with_(X.RESPONSES) + f"""
SELECT conv_id, turn, {EXAMPLE} AS text, CAST(length({EXAMPLE}) AS BIGINT) AS n_chars,
       NOT regexp_matches({X.py_strip('text')}, '[.!?]$') AS ends_mid_sentence
FROM responses"""


@oracle("chat_conversation")
def _():
    return """SELECT conv_id, turn, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered FROM conversations
UNION ALL
SELECT conv_id, max(turn) + 1, '<|im_start|>assistant' || chr(10) FROM conversations GROUP BY conv_id"""


@oracle("strip_think")
def _():
    inj = ("CASE WHEN conv_id % 3 = 0 THEN '<think>' || left(text, 40) || '</think>' || chr(10) || text "
           "WHEN conv_id % 3 = 1 THEN left(text, 30) || '</think>' || text ELSE text END")
    strict = X.strip_think("t")
    lenient = X.strip_think("t", lenient=True)
    return X.with_(X.RESPONSES) + f"""
, i AS (SELECT conv_id, turn, {inj} AS t FROM responses)
SELECT conv_id, turn, contains({strict}, '</think>') AS has_orphan,
       CAST(length({strict}) AS BIGINT) AS strict_chars, CAST(length({lenient}) AS BIGINT) AS lenient_chars,
       md5({strict}) AS strict_md5, md5({lenient}) AS lenient_md5
FROM i"""


@oracle("temperature_plan")
def _():
    return X.with_(X.PROMPTS, X.TEMPS) + """
SELECT p.prompt_id, t.temp_idx, t.temperature, greatest(t.temperature, 0.01::DOUBLE) AS eff_temperature,
       t.temperature > 0 AS do_sample, 0.9::DOUBLE AS top_p
FROM prompts p, temps t"""


@oracle("seeded_shuffle")
def _():
    return X.with_(X.PROMPTS, X.TEMPS, X.RANKED) + """
SELECT prompt_id, shuffle_key, CAST(shuffle_rank AS BIGINT) AS shuffle_rank FROM ranked"""


@oracle("group_split")
def _():
    return X.with_(X.PROMPTS, X.TEMPS, X.RANKED) + """
SELECT prompt_id, temperature, split FROM plan"""


@oracle("progress_index")
def _():
    return X.with_(X.PROMPTS, X.TEMPS, X.RANKED) + """
, p AS (SELECT prompt_id, temperature, CAST((shuffle_rank - 1) * 3 + temp_idx + 1 AS BIGINT) AS idx,
               CAST(n_prompts * 3 AS BIGINT) AS total FROM plan)
SELECT prompt_id, temperature, idx, total,
       '[' || CAST(idx AS VARCHAR) || '/' || CAST(total AS VARCHAR) || ']' AS label FROM p"""


@oracle("ordered_split")
def _():
    return X.with_(X.PROMPTS) + """
, r AS (SELECT prompt_id, row_number() OVER (ORDER BY prompt_id) AS rank, count(*) OVER () AS n FROM prompts)
SELECT prompt_id, CAST(rank AS BIGINT) AS rank,
       CASE WHEN rank - 1 < floor(n * 0.85::DOUBLE) THEN 'train' ELSE 'valid' END AS split
FROM r"""


@oracle("split_counts")
def _():
    return X.with_(X.PROMPTS, X.TEMPS, X.RANKED) + """
SELECT split, CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(temp_idx = 0) AS BIGINT) AS n_prompts
FROM (SELECT * FROM plan WHERE split = 'train' UNION ALL SELECT * FROM plan WHERE split = 'valid')
GROUP BY split"""


@oracle("split_leakage")
def _():
    norm = f"lower(regexp_replace({X.py_strip('prompt')}, '[{X.WS_BODY}]+', ' ', 'g'))"
    return X.with_(X.PROMPTS, X.TEMPS, X.RANKED) + f"""
, n AS (SELECT prompt_id, split, {norm} AS norm FROM split),
tr AS (SELECT * FROM n WHERE split = 'train'), va AS (SELECT * FROM n WHERE split = 'valid')
SELECT 'same_prompt_id' AS "check", CAST(count(*) AS BIGINT) AS n
FROM tr WHERE prompt_id IN (SELECT prompt_id FROM va)
UNION ALL
SELECT 'same_prompt_text', CAST(count(*) AS BIGINT) FROM tr WHERE norm IN (SELECT norm FROM va)
UNION ALL
SELECT 'train_after_anti_join', CAST(count(*) AS BIGINT) FROM tr WHERE norm NOT IN (SELECT norm FROM va)"""


@oracle("batch_plan")
def _():
    return X.with_(X.PROMPTS, X.TEMPS, X.RANKED) + """
, ex AS (SELECT prompt_id, temp_idx, CAST(prompt_id AS VARCHAR) || ':' || CAST(temp_idx AS VARCHAR) AS example_id
         FROM plan WHERE split = 'train'),
ep AS (SELECT prompt_id, temp_idx, example_id, CAST(e AS INTEGER) AS epoch FROM ex, range(0, 3) t(e)),
rk AS (SELECT epoch, prompt_id, temp_idx,
              row_number() OVER (PARTITION BY epoch ORDER BY
                 md5(CAST(epoch + 42 AS VARCHAR) || ':' || example_id), example_id) AS rank,
              count(*) OVER (PARTITION BY epoch) AS n
       FROM ep),
st AS (SELECT epoch, prompt_id, temp_idx, CAST(rank AS BIGINT) AS rank,
              CAST(floor((rank - 1) / 2) AS BIGINT) AS micro_batch,
              CAST(epoch * ceil(n / 8) + floor((rank - 1) / 8) AS BIGINT) AS global_step
       FROM rk)
SELECT *, global_step % 5 = 0 AS log_step, global_step % 25 = 0 AS eval_step,
       global_step % 25 = 0 AS save_step
FROM st"""


CALIB = f"""calib AS (
  SELECT s.split, {CHAT_USER} || r.prompt || {CHAT_MID} || r.text || '<|im_end|>' AS text
  FROM responses r JOIN split s ON r.prompt_id = s.prompt_id)"""


@oracle("jsonl_roundtrip")
def _():
    return X.with_(X.PROMPTS, X.RESPONSES, X.TEMPS, X.RANKED, CALIB) + """
SELECT split, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM calib"""


ORACLES["materialize_if_absent"] = ORACLES["jsonl_roundtrip"]


@oracle("present_sources")
def _():
    return """SELECT 'documents' AS source_table, CAST(count(*) AS BIGINT) AS n_rows FROM documents
UNION ALL SELECT 'labels', CAST(count(*) AS BIGINT) FROM labels
UNION ALL SELECT 'pages', CAST(count(*) AS BIGINT) FROM pages"""


# ---------------------------------------------------------------- tokens and language models
TOKS = f"""toks AS (
  SELECT doc_id, lang, {X.words('lower(text)')} AS toks FROM documents)"""

UNI = """uni AS (SELECT lang, tok, count(*) AS n FROM (SELECT lang, unnest(toks) AS tok FROM toks) GROUP BY ALL),
gw AS (SELECT tok, sum(n) AS n_w FROM uni GROUP BY tok),
tot AS (SELECT sum(n_w) AS N, count(*) AS V FROM gw)"""


def _bigrams(lang_filter: str = "") -> str:
    return f"""bi0 AS (SELECT lang, toks, unnest(range(1, len(toks))) AS i FROM toks {lang_filter}),
bi AS (SELECT lang, toks[i] AS ctx, toks[i + 1] AS tok, count(*) AS c FROM bi0 GROUP BY ALL)"""


def _feistel(x: str) -> str:
    """One pass of the keyed network over ``x``, rounds unrolled; b1, b2, key are columns."""
    left, right = f"({x} >> b2)", f"({x} & ((1::BIGINT << b2) - 1))"
    for k in range(1, 5):
        mixed = f"((((({right} + key * 7919 + {k}) * 40503) & 4294967295) * 31153 >> 9) & ((1::BIGINT << {'b1' if k % 2 else 'b2'}) - 1))"
        left, right = right, f"xor({left}, {mixed})"
    return f"(({left} << b2) | {right})"


@oracle("permuted_batch_plan")
def _():
    return "WITH RECURSIVE " + ",\n".join([X.PROMPTS, X.TEMPS, X.RANKED]) + f""",
ex AS (SELECT prompt_id, temp_idx, row_number() OVER (ORDER BY prompt_id, temp_idx) - 1 AS number, count(*) OVER () AS n FROM plan WHERE split = 'train'),
ep AS (SELECT prompt_id, temp_idx, number, n, CAST(e AS INTEGER) AS epoch, e + 42 AS key, greatest(2, length(bin(greatest(n - 1, 1)))) AS bits FROM ex, range(0, 3) r(e)),
eb AS (SELECT *, CAST(bits // 2 AS INTEGER) AS b1, CAST(bits - bits // 2 AS INTEGER) AS b2 FROM ep),
walk AS (SELECT prompt_id, temp_idx, epoch, key, n, b1, b2, {_feistel('number')} AS x FROM eb
         UNION ALL SELECT prompt_id, temp_idx, epoch, key, n, b1, b2, {_feistel('x')} AS x FROM walk WHERE x >= n)
SELECT epoch, prompt_id, temp_idx, x AS place, x // 2 AS micro_batch, CAST(epoch * ceil(n / 8.0) + x // 8 AS BIGINT) AS global_step FROM walk WHERE x < n"""


@oracle("token_windows")
def _():
    tid = f"({X.md5_int('w')} % 50000) + 1"
    return f"""WITH t AS (SELECT doc_id, list_transform({X.words('text')}, lambda w: {tid}) AS ids FROM documents),
win AS (SELECT doc_id, len(ids) AS n, list_resize(ids[1:2048], 2048, 0) AS input_ids FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, CAST(least(n, 2048) AS BIGINT) AS n_kept,
       n > 2048 AS truncated,
       CAST(list_sum(list_transform(input_ids, lambda x, i: x * i)) AS BIGINT) AS id_checksum,
       CAST(list_sum(list_transform(input_ids, lambda x, i: (CASE WHEN x = 0 THEN -100 ELSE x END) * i))
            AS BIGINT) AS label_checksum,
       CAST(least(n, 2048) AS BIGINT) AS n_attended
FROM win"""


@oracle("next_token_pairs")
def _():
    tid = f"({X.md5_int('w')} % 50000) + 1"
    return f"""WITH t AS (SELECT doc_id, list_transform({X.words('text')}, lambda w: {tid}) AS ids FROM documents)
SELECT doc_id, CAST(greatest(len(ids) - 1, 0) AS BIGINT) AS n_pairs,
       CAST(coalesce(list_sum(list_transform(range(1, len(ids)),
            lambda i: ((ids[i] * 50021 + ids[i + 1]) % 1000003) * i)), 0) AS BIGINT) AS pair_checksum
FROM t"""


@oracle("unigram_perplexity")
def _():
    return X.with_(TOKS, UNI) + """
SELECT CAST(N AS BIGINT) AS n_tokens, CAST(V AS BIGINT) AS vocab,
       round(exp((SELECT -sum(n_w * ln((n_w + 1) / (N + V + 1))) FROM gw) / N), 6) AS perplexity
FROM tot"""


@oracle("bigram_perplexity")
def _():
    return X.with_(TOKS, UNI, _bigrams()) + """
, m AS (SELECT lang, ctx, sum(c) AS m FROM bi GROUP BY ALL),
v AS (SELECT lang, count(*) AS V FROM uni GROUP BY lang)
SELECT bi.lang, CAST(sum(c) AS BIGINT) AS n_bigrams, CAST(any_value(v.V) AS BIGINT) AS vocab,
       round(exp(-sum(c * ln((c + 1) / (m.m + v.V))) / sum(c)), 4) AS perplexity
FROM bi JOIN m ON bi.lang = m.lang AND bi.ctx = m.ctx JOIN v ON bi.lang = v.lang
GROUP BY bi.lang"""


@oracle("perplexity_by_group")
def _():
    return X.with_(TOKS, UNI) + """
, s AS (SELECT uni.lang, uni.n, ln((gw.n_w + 1) / (tot.N + tot.V + 1)) AS logp
        FROM uni JOIN gw ON uni.tok = gw.tok, tot)
SELECT lang, CAST(grouping(lang) AS INTEGER) AS is_total, CAST(sum(n) AS BIGINT) AS n_tokens, round(-sum(n * logp) / sum(n), 6) AS mean_loss,
       round(exp(-sum(n * logp) / sum(n)), 4) AS perplexity
FROM s GROUP BY ROLLUP (lang)"""


@oracle("kl_unigram")
def _():
    return X.with_(TOKS, UNI) + """
, nl AS (SELECT lang, sum(n) AS N FROM uni GROUP BY lang)
SELECT uni.lang,
       round(sum((uni.n / nl.N) * ln((uni.n / nl.N) / ((gw.n_w + 1) / (tot.N + tot.V)))), 6) AS kl
FROM uni JOIN gw ON uni.tok = gw.tok JOIN nl ON uni.lang = nl.lang, tot
GROUP BY uni.lang"""


@oracle("temperature_distribution")
def _():
    return X.with_(TOKS, _bigrams()) + """
, ct AS (SELECT lang, ctx, sum(c) AS tot, max(c) AS mx FROM bi GROUP BY lang, ctx),
w AS (SELECT t.T, bi.lang, bi.ctx, pow(bi.c / ct.mx, 1.0 / t.T) AS w
      FROM bi JOIN ct ON bi.lang = ct.lang AND bi.ctx = ct.ctx,
           (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE)) t(T)),
p AS (SELECT T, lang, ctx, w / sum(w) OVER (PARTITION BY T, lang, ctx) AS p FROM w)
SELECT T AS temperature, lang, ctx, CAST(count(*) AS BIGINT) AS n_succ, round(max(p) + 1e-12, 6) AS max_p,
       round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) + 0.0 AS entropy
FROM p GROUP BY T, lang, ctx"""


@oracle("temperature_probabilities")
def _():
    return X.with_(TOKS, _bigrams()) + """
, w AS (SELECT t.T, bi.lang, bi.ctx, bi.tok, pow(bi.c::DOUBLE, 1.0 / t.T) AS w
        FROM bi, (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE)) t(T))
SELECT lang, ctx, tok, T AS temperature, round(w / sum(w) OVER (PARTITION BY T, lang, ctx) + 1e-12, 6) AS p FROM w"""


@oracle("nucleus_filter")
def _():
    return X.with_(TOKS, _bigrams()) + """
, w AS (SELECT lang, ctx, tok, c,
               CAST(coalesce(sum(c) OVER (PARTITION BY lang, ctx ORDER BY c DESC, tok
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior,
               CAST(sum(c) OVER (PARTITION BY lang, ctx) AS BIGINT) AS total
        FROM bi)
SELECT lang, ctx, tok, c, prior, total FROM w WHERE prior * 10 < total * 9"""


@oracle("greedy_next")
def _():
    return X.with_(TOKS, _bigrams()) + """
SELECT lang, ctx, first(tok ORDER BY c DESC, tok) AS tok, max(c) AS c, CAST(sum(c) AS BIGINT) AS total
FROM bi GROUP BY lang, ctx"""


# ---------------------------------------------------------------- losses over the logits view
STU = """stu AS (
  SELECT vec_id, label, CASE WHEN vec_id % 7 = 0 THEN -100 ELSE label END AS target,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 10.0) AS z
  FROM embeddings),
stu1 AS (SELECT *, list_max(z) AS mx, list_max(list_transform(z, lambda x: x * 0.25)) AS mx_t FROM stu),
s AS (SELECT *, mx + ln(list_sum(list_transform(z, lambda x: exp(x - mx)))) AS lse,
             mx_t + ln(list_sum(list_transform(z, lambda x: exp(x * 0.25 - mx_t)))) AS lse_t FROM stu1)"""


def _teacher(where: str = "") -> str:
    return f"""cells AS (
  SELECT label, i, avg(x) AS m
  FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) AS i
        FROM embeddings {where})
  GROUP BY label, i),
tch AS (SELECT label, list(m * 10.0 ORDER BY i) AS t FROM cells GROUP BY label),
tch1 AS (SELECT label, t, list_max(list_transform(t, lambda x: x * 0.25)) AS tm FROM tch),
tch2 AS (SELECT label, t, tm + ln(list_sum(list_transform(t, lambda x: exp(x * 0.25 - tm)))) AS t_lse FROM tch1),
tch3 AS (SELECT label, t, list_transform(t, lambda x: exp(x * 0.25 - t_lse)) AS p_t FROM tch2)"""


KL_ROW = ("16.0 * list_sum(list_transform(range(1, len(z) + 1), "
          "lambda i: p_t[i] * (ln(p_t[i]) - (z[i] * 0.25 - lse_t))))")


@oracle("softmax_rows")
def _():
    return X.with_(STU) + """
SELECT vec_id, label, round(lse, 6) AS logsumexp, round(exp(z[label + 1] - lse), 6) AS p_label,
       round(exp(mx - lse), 6) AS p_max, round(exp(z[label + 1] * 0.25 - lse_t), 6) AS p_label_t
FROM s"""


@oracle("ce_logits")
def _():
    return X.with_(STU) + """
, r AS (SELECT vec_id // 8 AS batch_id, CASE WHEN target = -100 THEN NULL ELSE lse - z[target + 1] END AS loss
        FROM s)
SELECT batch_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(loss) AS BIGINT) AS n_unmasked,
       round(avg(loss), 6) AS ce_mean
FROM r GROUP BY batch_id"""


@oracle("kl_logits")
def _():
    return X.with_(STU, _teacher()) + f"""
, r AS (SELECT s.vec_id // 8 AS batch_id, s.target,
               CASE WHEN s.target = -100 THEN 0.0 ELSE {KL_ROW} END AS kl
        FROM s JOIN tch3 ON s.label = tch3.label)
SELECT batch_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(target <> -100) AS BIGINT) AS n_unmasked,
       round(sum(kl) / count(*), 6) AS kl_batchmean,
       round(sum(kl) / nullif(count_if(target <> -100), 0), 6) AS kl_token_mean
FROM r GROUP BY batch_id"""


@oracle("blended_loss")
def _():
    return X.with_(STU, _teacher()) + f"""
, r AS (SELECT s.vec_id // 8 AS batch_id, (s.vec_id // 8) % 3 <> 0 AS has_teacher,
               CASE WHEN s.target = -100 THEN NULL ELSE s.lse - s.z[s.target + 1] END AS ce,
               CASE WHEN s.target = -100 THEN 0.0 ELSE {KL_ROW} END AS kl,
               CASE WHEN s.target = -100 THEN NULL
                    ELSE 16.0 * (s.lse_t - s.z[s.target + 1] * 0.25) END AS soft_ce
        FROM s JOIN tch3 ON s.label = tch3.label),
b AS (SELECT batch_id, any_value(has_teacher) AS has_teacher, count(*) AS n, avg(ce) AS ce,
             CASE WHEN any_value(has_teacher) THEN sum(kl) / count(*) ELSE avg(soft_ce) END AS soft
      FROM r GROUP BY batch_id)
SELECT batch_id, has_teacher, CAST(n AS BIGINT) AS n_rows, round(ce, 6) AS ce_mean, round(soft, 6) AS soft_mean,
       round(0.7::DOUBLE * soft + (1 - 0.7::DOUBLE) * ce, 6) AS loss
FROM b"""


# ---------------------------------------------------------------- quantisation
from quire.sources import literals as _L  # noqa: E402

BITS = "(VALUES (3), (5), (6), (8)) b(bits)"
GV = """gv AS (
  SELECT * EXCLUDE (whole), whole[grp * 64 + 1:grp * 64 + 64] AS v
  FROM (SELECT * EXCLUDE (v), v AS whole, unnest(range(0, CAST(ceil(len(v) / 64.0) AS INTEGER))) AS grp FROM {table}))"""
QQ = """qq AS (
  SELECT *, list_transform(v, lambda x: CAST(CASE WHEN scale > 0
            THEN least(greatest(round((x - mn) / scale), 0.0), lv) ELSE 0.0 END AS INTEGER)) AS q
  FROM qv),
qe AS (
  SELECT *, list_transform(range(1, len(v) + 1), lambda i: mn + q[i] * scale - v[i]) AS err FROM qq)"""
QV = GV.format(table="vectors") + f""",
qv AS (
  SELECT vec_id, label, grp, bits, v, list_min(v) AS mn, pow(2.0, bits) - 1 AS lv,
         (list_max(v) - list_min(v)) / (pow(2.0, bits) - 1) AS scale
  FROM gv, {BITS}),
""" + QQ

POLICY = r"""pol AS (
  SELECT *, TRY_CAST(regexp_extract(path, '(?:^|\.)layers\.(\d+)(?:\.|$)', 1) AS INTEGER) AS layer
  FROM segments),
pol2 AS (
  SELECT *, CASE WHEN module = 'norm' THEN NULL
                 WHEN contains(path, 'k_proj') OR contains(path, 'v_proj') THEN 6
                 WHEN contains(path, 'down_proj') AND ((layer IS NOT NULL AND layer < 3)
                      OR (layer IS NOT NULL AND layer >= (SELECT max(layer) + 1 FROM pol) - 3)) THEN 6
                 WHEN contains(path, 'o_proj') AND layer IS NOT NULL AND layer >= (SELECT max(layer) + 1 FROM pol) - 3 THEN 6
                 ELSE 5 END AS bits,
            CASE WHEN module <> 'norm' THEN 64 END AS group_size
  FROM pol)"""


@oracle("precision_policy")
def _():
    return X.with_(X.VECTORS, X.SEGMENTS, POLICY) + """
SELECT path, module, bits, group_size, CAST(count(*) AS BIGINT) AS n_vectors, any_value(layer) AS layer
FROM pol2 GROUP BY path, module, bits, group_size"""


@oracle("quantize_groupwise")
def _():
    return X.with_(X.VECTORS, QV) + """
SELECT vec_id, bits, CAST(grp AS INTEGER) AS grp, round(scale, 12) AS scale, round(mn, 12) AS bias,
       array_to_string(list_transform(q, lambda c: printf('%02x', c)), '') AS codes,
       round(list_sum(list_transform(err, lambda e: e * e)), 12) AS sse
FROM qe"""


@oracle("quant_error_by_bits")
def _():
    return X.with_(X.VECTORS, QV) + """
SELECT bits, CAST(sum(len(v)) AS BIGINT) AS n_values,
       round(sum(list_sum(list_transform(err, lambda e: e * e))) / sum(len(v)), 12) AS mse,
       round(max(list_max(list_transform(err, lambda e: abs(e)))), 9) AS max_abs
FROM qe GROUP BY bits"""


@oracle("quantize_mixed")
def _():
    return X.with_(X.VECTORS, X.SEGMENTS, POLICY) + """
, """ + GV.format(table="pol2") + """,
qv AS (SELECT bits, grp, v, list_min(v) AS mn, pow(2.0, bits) - 1 AS lv,
              (list_max(v) - list_min(v)) / (pow(2.0, bits) - 1) AS scale FROM gv),
""" + QQ + """
SELECT bits, CAST(count_if(grp = 0) AS BIGINT) AS n_vectors,
       round(sum(CASE WHEN bits IS NULL THEN 0.0 ELSE list_sum(list_transform(err, lambda e: e * e)) END) / sum(len(v)), 12) AS mse
FROM qe GROUP BY bits"""


@oracle("quantize_nf4")
def _():
    mids = _L.sql_double_list(_L.NF4_MIDPOINTS)
    codes = _L.sql_double_list(_L.NF4_CODES)
    return X.with_(X.VECTORS) + f"""
, {GV.format(table="(SELECT *, len(v) AS d FROM vectors)")},
b AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS absmax,
             (vec_id * CAST(ceil(d / 64.0) AS BIGINT) + grp) // 256 AS dq_group FROM gv),
c AS (SELECT *, list_transform(list_transform(v, lambda x: CASE WHEN absmax > 0 THEN x / absmax ELSE 0.0 END),
                               lambda y: len(list_filter({mids}, lambda m: m < y))) AS idx FROM b),
d AS (SELECT *, avg(absmax) OVER (PARTITION BY dq_group) AS mean_s FROM c),
e AS (SELECT *, max(abs(absmax - mean_s)) OVER (PARTITION BY dq_group) AS amax2 FROM d),
f AS (SELECT *, CASE WHEN amax2 > 0 THEN mean_s + round((absmax - mean_s) / (amax2 / 127.0)) * (amax2 / 127.0)
                     ELSE absmax END AS absmax_dq FROM e),
g AS (SELECT dq_group, len(v) AS n,
             list_sum(list_transform(range(1, len(v) + 1), lambda i:
                 (({codes})[idx[i] + 1] * absmax - v[i]) * (({codes})[idx[i] + 1] * absmax - v[i]))) AS sse,
             list_sum(list_transform(range(1, len(v) + 1), lambda i:
                 (({codes})[idx[i] + 1] * absmax_dq - v[i]) * (({codes})[idx[i] + 1] * absmax_dq - v[i]))) AS sse_dq
      FROM f)
SELECT dq_group, CAST(count(*) AS BIGINT) AS n_blocks, round(sum(sse) / sum(n), 10) AS mse_nf4,
       round(sum(sse_dq) / sum(n), 10) AS mse_nf4_dq
FROM g GROUP BY dq_group"""


@oracle("topk_fidelity")
def _():
    def top(arr):
        return (f"list_transform(list_sort(list_transform({arr}, lambda x, i: {{'k': -x, 'i': i}}))[1:10], "
                f"lambda s: s.i)")
    return X.with_(X.VECTORS, QV) + f"""
, d AS (SELECT bits, flatten(list(v ORDER BY grp)) AS v, flatten(list(list_transform(q, lambda x: mn + x * scale) ORDER BY grp)) AS deq
       FROM qq GROUP BY vec_id, bits)
SELECT bits, CAST(count(*) AS BIGINT) AS n_vectors,
       round(avg(len(list_intersect({top('v')}, {top('deq')})) / 10.0), 6) AS recall_at_10
FROM d GROUP BY bits"""


VARIANTS = """vr AS (
  SELECT vec_id, 0 AS bits, v FROM vectors
  UNION ALL
  SELECT vec_id, bits, flatten(list(list_transform(q, lambda x: mn + x * scale) ORDER BY grp)) AS v FROM qq GROUP BY vec_id, bits)"""
TRUTH = """pairs AS (
  SELECT a.vec_id AS q, b.vec_id AS r, b.bits, round(list_inner_product(a.v, b.v), 9) AS score
  FROM vr a JOIN vr b ON a.vec_id % 50 = 0 AND a.bits = b.bits AND a.vec_id <> b.vec_id),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY q, bits ORDER BY score DESC, r) <= 10),
truth AS (SELECT q, r FROM best WHERE bits = 0)"""


def _recall(found: str) -> str:
    return f"""SELECT w.bits, (SELECT count(DISTINCT q) FROM truth) AS n_queries,
       round((SELECT count(*) FROM truth t JOIN {found} f USING (q, r) WHERE f.bits = w.bits) / (SELECT count(*) FROM truth)::DOUBLE, 6) AS recall_at_10
FROM (SELECT DISTINCT bits FROM {found}) w"""


@oracle("neighbour_recall")
def _():
    return X.with_(X.VECTORS, QV, VARIANTS, TRUTH) + _recall("best") + " WHERE w.bits > 0"


def _near(c: str) -> str:
    return f"round(list_inner_product(v.v, {c}.c) - 0.5 * list_inner_product({c}.c, {c}.c), 9) DESC, {c}.list"


@oracle("neighbour_recall_lists")
def _():
    steps = ["""k AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS k FROM vectors),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS list, v AS c FROM vectors
       QUALIFY row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) <= (SELECT k FROM k))"""]
    for i in (1, 2):
        steps.append(f"""a{i} AS (SELECT v.v, c.list FROM vectors v, c{i - 1} c QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY {_near('c')}) = 1),
m{i} AS (SELECT list, list(x ORDER BY d) AS c FROM (
       SELECT list, d, avg(v[d]) AS x FROM a{i}, range(1, 4097) r(d) WHERE d <= len(v) GROUP BY list, d) GROUP BY list),
c{i} AS MATERIALIZED (SELECT o.list, coalesce(m.c, o.c) AS c FROM c{i - 1} o LEFT JOIN m{i} m USING (list))""")
    steps.append(f"""lists AS (SELECT v.vec_id, c.list FROM vectors v, c2 c QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY {_near('c')}) = 1),
probes AS (SELECT v.vec_id, c.list FROM vectors v, c2 c WHERE v.vec_id % 50 = 0
       QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY {_near('c')}) <= ceil(0.7::DOUBLE * (SELECT k FROM k))),
seen AS (SELECT p.q, p.r, p.bits FROM pairs p JOIN lists l ON l.vec_id = p.r JOIN probes b ON b.vec_id = p.q AND b.list = l.list
       QUALIFY row_number() OVER (PARTITION BY q, bits ORDER BY score DESC, r) <= 10)""")
    return X.with_(X.VECTORS, QV, VARIANTS, TRUTH, *steps) + _recall("seen")


PACKED = """bit_strings AS (
  SELECT vec_id, bits, CAST(sum(len(q)) AS INTEGER) AS n_codes,
         string_agg(array_to_string(list_transform(q, lambda c: lpad(bin(c), bits, '0')), ''), '' ORDER BY grp) AS b
  FROM qq GROUP BY vec_id, bits),
packed AS (
  SELECT vec_id, bits, n_codes, (len(b) + 7) // 8 AS n_bytes, rpad(b, CAST((len(b) + 7) // 8 * 8 AS INTEGER), '0') AS b FROM bit_strings)"""


@oracle("pack_codes")
def _():
    return X.with_(X.VECTORS, QV, PACKED) + """
SELECT vec_id, bits, n_codes, CAST(n_bytes AS INTEGER) AS n_bytes,
       array_to_string(list_transform(range(0, n_bytes), lambda i: printf('%02x', list_sum(list_transform(range(1, 9),
         lambda j: CAST(b[8 * i + j] AS INTEGER) * (1 << (8 - j))))::INTEGER)), '') AS packed
FROM packed"""


@oracle("unpack_codes")
def _():
    return X.with_(X.VECTORS, QV) + """
SELECT vec_id, bits, CAST(grp AS INTEGER) AS grp, array_to_string(list_transform(q, lambda c: printf('%02x', c)), '') AS codes,
       round(mn::FLOAT::DOUBLE + q[1] * scale::FLOAT::DOUBLE, 6) AS first_value
FROM qe"""


@oracle("packed_footprint")
def _():
    return X.with_(X.VECTORS, X.SEGMENTS, POLICY) + f"""
, s AS (SELECT 'mixed' AS scheme, len(v) AS d, bits FROM pol2
       UNION ALL SELECT 'uniform_' || b.bits, len(v), b.bits FROM pol2, {BITS})
SELECT scheme, count(*) AS n_vectors,
       CAST(sum(CASE WHEN bits IS NULL THEN 4 * d ELSE ceil(d * bits / 8.0) END) AS BIGINT) AS code_bytes,
       CAST(sum(CASE WHEN bits IS NULL THEN 0 ELSE 8 * ceil(d / 64.0) END) AS BIGINT) AS scale_bytes
FROM s GROUP BY scheme"""


@oracle("lowrank_checks")
def _():
    return X.with_(X.VECTORS, QV) + """
, t AS (SELECT CAST(sum(len(v)) AS BIGINT) AS n_values, sum(list_sum(list_transform(err, lambda e: e * e))) AS trace FROM qe WHERE bits = 3)
SELECT 0 AS rank, n_values, round(trace, 6) AS trace, round(trace / n_values, 9) AS mse, 0.0::DOUBLE AS off_orthonormal FROM t
UNION ALL
SELECT (SELECT CAST(max(len(v)) AS INTEGER) FROM vectors), n_values, round(trace, 6), 0.0::DOUBLE, 0.0::DOUBLE FROM t"""


@oracle("footprint_by_bits")
def _():
    return X.with_(X.VECTORS, X.SEGMENTS, POLICY) + f"""
, u AS (SELECT 'uniform_' || CAST(b.bits AS VARCHAR) AS scheme, b.bits, v FROM pol2, {BITS.replace('b(bits)', 'b(bits)')}
        UNION ALL SELECT 'mixed', bits, v FROM pol2),
t AS (SELECT scheme, CAST(count(*) AS BIGINT) AS n_vectors,
             CAST(sum(CASE WHEN bits IS NULL THEN len(v) * 4
                      ELSE ceil(len(v) * bits / 8.0) + ceil(len(v) / 64.0) * 8 END) AS BIGINT) AS total_bytes,
             CAST(sum(len(v) * 4) AS BIGINT) AS fp32_bytes
      FROM u GROUP BY scheme)
SELECT *, round(total_bytes / fp32_bytes, 6) AS ratio FROM t"""


# ---------------------------------------------------------------- needles and haystacks
def _fill_values() -> str:
    return ", ".join(f"({i}, {X.q(s)})" for i, s in enumerate(_L.FILLER_SENTENCES))


HAY = f"""fill AS (
  SELECT choice, sentence, {X.word_count('sentence')} AS words
  FROM (VALUES {_fill_values()}) t(choice, sentence)),
sizes AS (SELECT * FROM (VALUES (8192), (32768), (65536), (128000)) s(target_tokens)),
draws AS (
  SELECT b.item_id, b.text AS needle, s.target_tokens, sl.slot,
         CAST({X.md5_int("'42:' || CAST(b.item_id AS VARCHAR) || ':' || CAST(s.target_tokens AS VARCHAR) || ':' || CAST(sl.slot AS VARCHAR)")} % 10 AS INTEGER) AS choice
  FROM benchmark b, sizes s, range(0, 5000) sl(slot)
  WHERE sl.slot < s.target_tokens // 4 // 8 + 2),
hd AS (
  SELECT dr.item_id, dr.needle, dr.target_tokens, dr.slot, f.sentence, f.words,
         dr.target_tokens // 4 AS target_words, {X.word_count('dr.needle')} AS needle_words,
         coalesce(sum(f.words) OVER (PARTITION BY dr.item_id, dr.target_tokens ORDER BY dr.slot
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM draws dr JOIN fill f ON dr.choice = f.choice),
hd2 AS (
  SELECT *, min(CASE WHEN prior >= target_words // 2 AND prior < target_words THEN slot END)
            OVER (PARTITION BY item_id, target_tokens) AS k
  FROM hd),
hd3 AS (
  SELECT *, count(*) OVER (PARTITION BY item_id, target_tokens) AS n_kept FROM hd2
  WHERE CASE WHEN k IS NOT NULL THEN slot <= k OR prior + needle_words < target_words
             ELSE prior < target_words END),
hrows AS (
  SELECT item_id, target_tokens, CAST(slot AS DOUBLE) AS pos, sentence, words, FALSE AS is_needle,
         target_words FROM hd3
  UNION ALL
  SELECT item_id, target_tokens,
         CASE WHEN any_value(k) IS NOT NULL THEN any_value(k) ELSE any_value(n_kept) // 2 END - 0.5,
         any_value(needle), any_value(needle_words), TRUE, any_value(target_words)
  FROM hd3 GROUP BY item_id, target_tokens)"""


@oracle("filler_sample")
def _():
    return X.with_(HAY) + """
SELECT item_id, target_tokens, CAST(count(*) AS BIGINT) AS n_slots,
       CAST(sum(choice * (slot + 1)) AS BIGINT) AS choice_checksum,
       CAST(count(DISTINCT choice) AS BIGINT) AS n_distinct
FROM draws GROUP BY item_id, target_tokens"""


@oracle("haystack_build")
def _():
    return X.with_(HAY) + """
SELECT item_id, target_tokens, CAST(count_if(NOT is_needle) AS BIGINT) AS n_sentences,
       CAST(max(CASE WHEN is_needle THEN pos + 0.5 END) AS BIGINT) AS needle_pos,
       CAST(sum(words) AS BIGINT) AS actual_words, CAST(any_value(target_words) AS BIGINT) AS target_words
FROM hrows GROUP BY item_id, target_tokens"""


@oracle("haystack_text")
def _():
    head = X.q(_L.CHAT_USER_OPEN + _L.HAYSTACK_QUESTION_HEAD)
    tail = X.q(_L.HAYSTACK_QUESTION_TAIL + _L.CHAT_END + "\n" + _L.CHAT_ASSISTANT_OPEN)
    return X.with_(HAY) + f"""
, h AS (SELECT item_id, target_tokens, string_agg(sentence, ' ' ORDER BY pos) AS hay
        FROM hrows GROUP BY item_id, target_tokens)
SELECT item_id, target_tokens, md5({head} || hay || {tail}) AS prompt_md5,
       CAST(length({head} || hay || {tail}) AS BIGINT) AS n_chars, {X.word_count('hay')} AS n_words
FROM h"""


FIND = """found AS (
  SELECT b.item_id, d.doc_id, CAST(instr(d.text, b.text) AS BIGINT) AS pos,
         round((instr(d.text, b.text) - 1) / length(d.text), 6) AS depth
  FROM documents d, benchmark b WHERE length(b.text) > 0 AND instr(d.text, b.text) > 0)"""


@oracle("needle_find")
def _():
    return X.with_(FIND) + "SELECT item_id, doc_id, pos, depth FROM found"


@oracle("needle_score")
def _():
    return X.with_(FIND) + f"""
, h AS (SELECT item_id, count(*) AS n_docs FROM found GROUP BY item_id)
SELECT b.item_id, {X.word_count('b.text')} AS n_words, CAST(coalesce(h.n_docs, 0) AS BIGINT) AS n_docs,
       coalesce(h.n_docs, 0) > 0 AS found
FROM benchmark b LEFT JOIN h ON b.item_id = h.item_id"""


# ---------------------------------------------------------------- generation and what follows it
def _answers(source: str, keep: str) -> str:
    """Both backends over a relation with a prompt column."""
    return f"""w AS (SELECT {keep}, {X.words('prompt')} AS ws FROM {source}),
answers AS (
  SELECT {keep}, model, CASE WHEN len(ws) = 0 THEN '' ELSE array_to_string(CASE WHEN model = 'A' THEN ws[1:2048]
           ELSE ws[len(ws) - least(2048, (len(ws) + 1) // 2) + 1:] END, ' ') END AS text,
         CASE WHEN len(ws) = 0 THEN 'ValueError: empty prompt' END AS error
  FROM w, (VALUES ('A'), ('B')) m(model))"""


GENERATED = X.PROMPTS + """,
plan AS (SELECT prompt_id, prompt, CAST((conv_id // 2 + (turn + 1) // 2) % 14 AS INTEGER) AS test_ord, CAST(i AS INTEGER) AS temp_idx
         FROM prompts, range(0, 3) t(i)),
""" + _answers("plan", "prompt_id, test_ord, temp_idx")


@oracle("batch_generate")
def _():
    return "WITH " + GENERATED + f"""
SELECT model, prompt_id, temp_idx, text, {X.word_count('text')} AS tok_count, error FROM answers"""


@oracle("resumed_generate")
def _():
    return "WITH " + GENERATED + f"""
SELECT model, prompt_id, temp_idx, text, {X.word_count('text')} AS tok_count, error,
       CAST(CASE WHEN error IS NULL THEN 1 ELSE 3 END AS BIGINT) AS attempts FROM answers"""


def _generated_scores() -> str:
    hay = X.strip_think("r.text")
    return GENERATED + ",\n" + X.RULES + f""",
checked AS (
  SELECT r.model, r.prompt_id, r.temp_idx, r.error, ru.rule_set, ru.suite, ru.test, ru.clause_id,
         bool_or(contains(CASE WHEN ru.prefix_chars IS NULL THEN h.hay ELSE left(h.hay, ru.prefix_chars) END, ru.needle)) AS clause_ok
  FROM answers r JOIN rules ru ON r.test_ord = ru.test_ord,
  LATERAL (SELECT CASE WHEN ru.ignore_case THEN lower(CASE WHEN ru.strip_think THEN {hay} ELSE r.text END)
                       ELSE CASE WHEN ru.strip_think THEN {hay} ELSE r.text END END AS hay) h
  GROUP BY ALL),
graded AS (
  SELECT model, prompt_id, temp_idx, error, rule_set, suite, test, bool_and(clause_ok) AND error IS NULL AS ok
  FROM checked GROUP BY model, prompt_id, temp_idx, error, rule_set, suite, test)"""


@oracle("generated_scores")
def _():
    return "WITH " + _generated_scores() + """
SELECT rule_set, model, suite, CAST(count_if(ok) AS BIGINT) AS passed, CAST(count(*) AS BIGINT) AS total,
       CAST(count(error) AS BIGINT) AS errors, round(100.0 * count_if(ok) / count(*), 6) AS score
FROM graded GROUP BY rule_set, model, suite"""


@oracle("side_by_side")
def _():
    return "WITH " + GENERATED + """
SELECT a.prompt_id, left(a.text, 200) AS a_preview, CAST(length(a.text) AS BIGINT) AS a_chars,
       left(b.text, 200) AS b_preview, CAST(length(b.text) AS BIGINT) AS b_chars
FROM answers a JOIN answers b ON a.prompt_id = b.prompt_id AND a.model = 'A' AND b.model = 'B'
     AND a.temp_idx = 0 AND b.temp_idx = 0"""


def _context_answers() -> str:
    head, tail = X.q(_L.HAYSTACK_QUESTION_HEAD), X.q(_L.HAYSTACK_QUESTION_TAIL)
    answers = _answers("h", "item_id, target_tokens, needle").replace("w AS (", "hw AS (").replace("answers AS (", "found_in AS (").replace("FROM w,", "FROM hw,")
    return HAY + f""",
h AS (SELECT item_id, target_tokens, {head} || string_agg(sentence, ' ' ORDER BY pos) || {tail} AS prompt,
               array_to_string({X.words("max(CASE WHEN is_needle THEN sentence END)")}, ' ') AS needle
        FROM hrows GROUP BY item_id, target_tokens),
""" + answers


@oracle("context_scores")
def _():
    return "WITH " + _context_answers() + """
SELECT model, target_tokens, CAST(count_if(contains(text, needle) AND error IS NULL) AS BIGINT) AS passed, CAST(count(*) AS BIGINT) AS total
FROM found_in GROUP BY model, target_tokens"""


# ---------------------------------------------------------------- count-based classifiers
EXAMPLES = f"""lab AS (SELECT doc_id, CAST(quality AS DOUBLE) AS y,
         row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk, count(*) OVER () AS n
       FROM labels WHERE quality IS NOT NULL),
ids AS (SELECT doc_id, y, CASE WHEN rk - 1 < floor(n * 0.85::DOUBLE) THEN 'train' ELSE 'valid' END AS split FROM lab),
docs AS (SELECT i.doc_id, i.y, i.split, {X.words('lower(d.text)')} AS ws FROM ids i JOIN documents d USING (doc_id)),
tok AS (SELECT doc_id, y, split, unnest(ws) AS tok FROM docs),
ex AS (SELECT doc_id, y, split, {X.md5_int('tok')} AS h, count(*) AS tf FROM tok GROUP BY doc_id, y, split, tok)"""


def _bayes(name: str, target: str, points: str, source: str = "docs") -> str:
    """Scores ``{name}_s`` (w, s, doc_id, y, split, score) of grid points (w, s) fitted on train."""
    return f"""{name}_d AS (SELECT DISTINCT doc_id, y, split, {target} AS t FROM {source}),
{name}_x AS (SELECT p.w, p.s, e.doc_id, e.split, e.y, e.h % p.w AS f, e.tf, d.t FROM ex e JOIN {name}_d d USING (doc_id), {points} p(w, s)),
{name}_c AS (SELECT w, s, f, sum(t * tf) AS c1, sum((1 - t) * tf) AS c0 FROM {name}_x WHERE split = 'train' GROUP BY w, s, f),
{name}_t AS (SELECT w, s, sum(c1) AS s1, sum(c0) AS s0 FROM {name}_c GROUP BY w, s),
{name}_p AS (SELECT ln(sum(t)) - ln(sum(1 - t)) AS prior FROM {name}_d WHERE split = 'train'),
{name}_w AS (SELECT w, s, f, ln((c1 + s) / (s1 + s * w)) - ln((c0 + s) / (s0 + s * w)) AS v FROM {name}_c JOIN {name}_t USING (w, s)),
{name}_g AS (SELECT x.w, x.s, x.doc_id, sum(x.tf * coalesce(v.v, ln(t.s0 + x.s * x.w) - ln(t.s1 + x.s * x.w))) AS g
             FROM {name}_x x JOIN {name}_t t USING (w, s) LEFT JOIN {name}_w v USING (w, s, f) GROUP BY x.w, x.s, x.doc_id),
{name}_s AS (SELECT t.w, t.s, d.doc_id, d.y, d.split, least(greatest(prior + coalesce(g.g, 0.0), -30.0), 30.0) AS score
             FROM {name}_d d CROSS JOIN {name}_p CROSS JOIN {name}_t t LEFT JOIN {name}_g g ON g.w = t.w AND g.s = t.s AND g.doc_id = d.doc_id)"""


_LOSS = "round(avg(ln(1 + exp(CASE WHEN y > 0 THEN -score ELSE score END))), 4)"
_TEACHER = _bayes("teach", "y", "(VALUES (4096, 1.0::DOUBLE))")


@oracle("distill_student")
def _():
    return "WITH " + ",\n".join([EXAMPLES, _TEACHER,
        "blend AS (SELECT doc_id, y, split, 0.7::DOUBLE * (1 / (1 + exp(-score))) + (1 - 0.7::DOUBLE) * y AS target FROM teach_s)",
        _bayes("soft", "target", "(VALUES (64, 1.0::DOUBLE))", "blend"), _bayes("hard", "y", "(VALUES (64, 1.0::DOUBLE))")]) + "".join(
        f"{' UNION ALL' * (k > 0)}\nSELECT '{name}' AS model, CAST(count(*) AS BIGINT) AS n_eval, {_LOSS} AS log_loss FROM {table} WHERE split = 'valid'"
        for k, (name, table) in enumerate([("teacher", "teach_s"), ("student_soft", "soft_s"), ("student_hard", "hard_s")]))


@oracle("valid_loss")
def _():
    return "WITH " + EXAMPLES + ",\n" + _TEACHER + f"""
SELECT split AS model, CAST(count(*) AS BIGINT) AS n_eval, {_LOSS} AS log_loss FROM teach_s GROUP BY split"""


@oracle("param_sweep")
def _():
    points = ", ".join(f"({w}, {s}::DOUBLE)" for w in (256, 4096) for s in (0.1, 1.0, 10.0))
    return "WITH " + EXAMPLES + ",\n" + _bayes("grid", "y", f"(VALUES {points})") + f"""
SELECT w AS num_features, s AS smoothing, {_LOSS} AS log_loss,
       round(avg(CASE WHEN (score > 0) = (y > 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS accuracy
FROM grid_s WHERE split = 'valid' GROUP BY w, s"""


STUDENT = ["""share AS (SELECT doc_id, f, tf / sum(tf) OVER (PARTITION BY doc_id) AS x FROM (SELECT doc_id, h % 64 AS f, sum(tf) AS tf FROM ex GROUP BY ALL)),
xf AS MATERIALIZED (SELECT doc_id, f, x FROM share UNION ALL SELECT doc_id, 64, 1.0::DOUBLE FROM docs),
tr AS MATERIALIZED (SELECT doc_id, y, split, score,
       """ + ", ".join(f"{X.md5_int(f"'{_L.SHUFFLE_SEED + e}:' || doc_id::VARCHAR")} % 32 AS slot{e}" for e in range(3)) + """
       FROM teach_s)""",
           "w0 AS (SELECT f, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM range(65) r(f))"]


def _sig(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


_P, _Q = _sig("score / 4.0::DOUBLE"), _sig("u / 4.0::DOUBLE")
_ROW_LOSS = (f"(0.7::DOUBLE * 16 * ({_P} * (ln({_P}) - ln({_Q})) + (1 - {_P}) * (ln(1 - {_P}) - ln(1 - {_Q})))"
             " + (1 - 0.7::DOUBLE) * ln(1 + exp(CASE WHEN y > 0 THEN -u ELSE u END)))")
_ROW_SLOPE = f"(0.7::DOUBLE * 4 * ({_Q} - {_P}) + (1 - 0.7::DOUBLE) * ({_sig('u')} - y))"


def _student_step(t: int) -> list[str]:
    """Logits, gradient and new weights of optimiser step ``t``."""
    e, s = divmod(t, 8)
    lr = 0.5 * (t + 1) / 4 if t < 4 else 0.25 * (1 + math.cos(math.pi * (t - 4) / 20))
    return [f"""u{t} AS MATERIALIZED (SELECT d.doc_id, any_value(y) AS y, any_value(score) AS score, any_value(slot{e} % 4) AS mb, sum(x * w) AS u
       FROM tr d JOIN xf USING (doc_id) JOIN w{t} USING (f) WHERE split = 'train' AND slot{e} // 4 = {s} GROUP BY d.doc_id)""",
            f"""g{t} AS MATERIALIZED (SELECT f, sum({_ROW_SLOPE} * x / n) / (SELECT count(DISTINCT mb) FROM u{t}) AS g
       FROM u{t} JOIN (SELECT mb, count(*) AS n FROM u{t} GROUP BY mb) USING (mb) JOIN xf USING (doc_id) GROUP BY f)""",
            f"""w{t + 1} AS MATERIALIZED (SELECT f, w - {lr!r}::DOUBLE * ((nm / (1 - pow(0.9::DOUBLE, {t + 1}))) / (sqrt(nv / (1 - pow(0.999::DOUBLE, {t + 1}))) + 1e-8::DOUBLE) + 0.01::DOUBLE * w) AS w, nm AS m, nv AS v
       FROM (SELECT f, w, 0.9::DOUBLE * m + (1 - 0.9::DOUBLE) * g AS nm, 0.999::DOUBLE * v + (1 - 0.999::DOUBLE) * g * g AS nv
             FROM (SELECT w.f, w.w, w.m, w.v, coalesce(g.g, 0) * least(1, coalesce(1 / (SELECT nullif(sqrt(sum(g * g)), 0) FROM g{t}), 1)) AS g FROM w{t} w LEFT JOIN g{t} g USING (f))))"""]


@oracle("student_gradient")
def _():
    return "WITH " + ",\n".join([EXAMPLES, _TEACHER, *STUDENT, *_student_step(0)[:2]]) + """
SELECT CAST(f AS INTEGER) AS feature, round(coalesce(g, 0.0), 9) AS gradient FROM w0 LEFT JOIN g0 USING (f)"""


@oracle("train_student")
def _():
    steps = [cte for t in range(24) for cte in _student_step(t)]
    valid = " UNION ALL ".join(f"SELECT {e} AS epoch, doc_id, any_value(y) AS y, any_value(score) AS score, sum(x * w) AS u FROM tr JOIN xf USING (doc_id) JOIN w{8 * e} USING (f) WHERE split = 'valid' GROUP BY doc_id" for e in range(4))
    train = " UNION ALL ".join(f"SELECT {t // 8 + 1} AS epoch, {t} AS t, avg({_ROW_LOSS}) AS loss FROM u{t}" for t in range(24))
    return "WITH " + ",\n".join([EXAMPLES, _TEACHER, *STUDENT, *steps, f"va AS ({valid})", f"tl AS (SELECT epoch, avg(loss) AS loss FROM ({train}) GROUP BY epoch)",
                                 f"vl AS (SELECT epoch, avg({_ROW_LOSS}) AS loss FROM va GROUP BY epoch)"]) + """
SELECT CAST(v.epoch AS INTEGER) AS epoch, CAST(8 * v.epoch AS INTEGER) AS steps, round(t.loss, 6) AS train_loss, round(v.loss, 6) AS valid_loss,
       v.loss = (SELECT min(loss) FROM vl) AS kept
FROM vl v LEFT JOIN tl t USING (epoch)"""


HELDOUT = f"""dsplit AS (
  SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 < floor(count(*) OVER () * 0.85::DOUBLE)
                      THEN 'train' ELSE 'valid' END AS split FROM documents),
dtok AS (SELECT doc_id, unnest({X.words('lower(text)')}) AS tok FROM documents),
dcnt AS (SELECT doc_id, tok, count(*) AS c FROM dtok GROUP BY ALL),
dmod AS (SELECT tok, sum(c) AS n FROM dcnt JOIN dsplit USING (doc_id) WHERE split = 'train' GROUP BY tok),
dz AS (SELECT sum(n) + count(*) + 1 AS z FROM dmod),
hloss AS (SELECT doc_id, sum(c) AS n, sum(-c * ln((coalesce(m.n, 0) + 1) / z)) AS loss
          FROM dcnt JOIN dsplit USING (doc_id) LEFT JOIN dmod m USING (tok), dz WHERE split = 'valid' GROUP BY doc_id)"""


@oracle("heldout_text_perplexity")
def _():
    return "WITH " + HELDOUT + """
SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, round(loss / n, 6) AS mean_loss, round(exp(loss / n), 4) AS perplexity FROM hloss"""


@oracle("heldout_perplexity")
def _():
    return "WITH " + HELDOUT + """
SELECT CAST(count(*) AS BIGINT) AS n_texts, CAST(sum(n) AS BIGINT) AS n_tokens, round(sum(loss) / sum(n), 6) AS mean_loss,
       round(exp(sum(loss) / sum(n)), 4) AS perplexity FROM hloss"""


@oracle("backoff_perplexity")
def _():
    def p(k: int, lower: str) -> str:
        return f"CASE WHEN n{k} > 0 THEN greatest(coalesce(c{k}, 0) - 0.75, 0) / n{k} + 0.75 * t{k} / n{k} * ({lower}) ELSE {lower} END"

    return "WITH " + HELDOUT.split(",\ndtok AS")[0] + f""",
wl AS (SELECT s.split, {X.words('lower(d.text)')} AS w FROM documents d JOIN dsplit s USING (doc_id)),
tg AS (SELECT split, CASE WHEN i > 2 THEN w[i - 2] ELSE '' END AS u, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS v, w[i] AS w
       FROM (SELECT split, w, unnest(range(1, len(w) + 1)) AS i FROM wl)),
tc AS (SELECT u, v, w, count(*) FILTER (WHERE split = 'train') AS c3, count(*) FILTER (WHERE split = 'valid') AS asked FROM tg GROUP BY ALL),
x3 AS (SELECT u, v, sum(c3) AS n3, count(*) AS t3 FROM tc WHERE c3 > 0 GROUP BY ALL),
c2 AS (SELECT v, w, count(*) AS c2 FROM tc WHERE c3 > 0 GROUP BY ALL),
x2 AS (SELECT v, sum(c2) AS n2, count(*) AS t2 FROM c2 GROUP BY v),
c1 AS (SELECT w, count(*) AS c1 FROM c2 GROUP BY w),
x1 AS (SELECT sum(c1) AS n1, count(*) AS t1 FROM c1),
j AS (SELECT asked, c3, n3, t3, c2, n2, t2, c1, n1::DOUBLE AS n1, t1 FROM tc LEFT JOIN x3 USING (u, v) LEFT JOIN c2 USING (v, w) LEFT JOIN x2 USING (v) LEFT JOIN c1 USING (w), x1 WHERE asked > 0),
p1 AS (SELECT *, {p(1, '1.0 / (t1 + 1)')} AS p1 FROM (SELECT * REPLACE (n3::DOUBLE AS n3, n2::DOUBLE AS n2) FROM j)),
p2 AS (SELECT *, {p(2, 'p1')} AS p2 FROM p1),
p3 AS (SELECT *, {p(3, 'p2')} AS p3 FROM p2)
SELECT k AS "order", CAST(sum(asked) AS BIGINT) AS n_tokens, round(sum(-asked * ln(p)) / sum(asked), 6) AS mean_loss,
       round(exp(sum(-asked * ln(p)) / sum(asked)), 3) AS perplexity
FROM (SELECT asked, unnest([1, 2, 3]) AS k, unnest([p1, p2, p3]) AS p FROM p3) GROUP BY k"""


@oracle("run_summary")
def _():
    return "WITH " + ",\n".join([_generated_scores(), _context_answers(), X.RUNS, HELDOUT]) + f""",
sc AS (SELECT model, count_if(ok) AS passed, count(*) AS total FROM graded GROUP BY model),
ct AS (SELECT model, count_if(contains(text, needle) AND error IS NULL) AS p, count(*) AS n FROM found_in GROUP BY model),
sp AS (SELECT model, round(avg({RATE}), 6) AS mean_tps FROM runs GROUP BY model)
SELECT sc.model, CAST(passed AS BIGINT) AS passed, CAST(total AS BIGINT) AS total, round(100.0 * passed / total, 6) AS score,
       CAST(ct.p AS BIGINT) AS contexts_passed, CAST(ct.n AS BIGINT) AS contexts,
       (SELECT round(exp(sum(loss) / sum(n)), 4) FROM hloss) AS perplexity, sp.mean_tps
FROM sc LEFT JOIN ct USING (model) LEFT JOIN sp USING (model)"""
