"""The results of the queries in plain SQL."""

import re

from bindings import queries as q
from pairloom import schemas as s
from pairloom.functions import prompts
from pairloom.functions.text import WHITESPACE

WS = WHITESPACE.replace("'", "''")
WS_CLASS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]"
FENCE = rf"```(?:python)?{WS_CLASS}*\n?"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(col: str) -> str:
    return f"trim({col}, '{WS}')"


def tok(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '{TOKEN}')"


def shown(col: str) -> str:
    return f"array_to_string(list_transform({col}, lambda x: CAST(x AS VARCHAR)), ' ') AS {col}"


def prompt_sql(task: str, text: str) -> str:
    cases = " ".join(
        f"WHEN {task} = '{name}' THEN concat({lit(head)}, {text}, {lit(chr(10) + tail)})"
        for name, (head, tail) in s.TASK_FORMATS.items()
    )
    return f"CASE {cases} ELSE {text} END"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


PAIRS = """pairs AS (
  SELECT conv_id * 1000000 + turn AS ex_id,
         CASE WHEN conv_id % 2 = 0 THEN 'task_1' ELSE 'task_2' END AS task,
         CASE WHEN conv_id % 10 = 0 THEN 'test' WHEN conv_id % 10 = 1 THEN 'validation' ELSE 'train' END AS split,
         text AS prompt, next_text AS answer
  FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
               lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
        FROM conversations) c
  WHERE role = 'user' AND next_role = 'assistant')"""

DIMS = """dims AS (
  SELECT (SELECT count(*) FROM benchmark) AS nb, (SELECT count(*) FROM documents) AS nd)"""


def run_keys(gen_id: str) -> str:
    return f"""{gen_id} // (3 * nb) AS run_id, {gen_id} % nb AS sample_id,
         CASE ({gen_id} // nb) % 3 WHEN 0 THEN 'candidate' WHEN 1 THEN 'base' ELSE 'cloud' END AS model"""


def task_of(sample_id: str) -> str:
    return f"CASE WHEN {sample_id} * 2 < nb THEN 'code_generation' ELSE 'docstring_generation' END"


GENERATIONS = f"""generations AS (
  SELECT doc_id AS gen_id, {run_keys("doc_id")},
         {task_of("(doc_id % nb)")} AS task, text AS raw_response,
         concat('Score: ', CAST((doc_id * 7) % 8 AS VARCHAR)) AS judge_response,
         CAST(n_chars % 3 AS DOUBLE) AS memory_mb
  FROM documents, dims)"""

SAMPLES = f"""run_samples AS (
  SELECT r.run_id, item_id AS sample_id, {task_of("item_id")} AS task,
         CASE WHEN item_id * 2 < nb THEN concat('fn_', CAST(item_id AS VARCHAR)) END AS function_name,
         CASE WHEN item_id * 2 >= nb THEN
           CASE WHEN item_id % 4 = 3 THEN concat('def doc_', CAST(item_id AS VARCHAR), '(x):', chr(10), '    pass')
           ELSE text END END AS code
  FROM benchmark, dims, (SELECT unnest(range((nd - 1) // (3 * nb) + 1)) AS run_id FROM dims) r)"""

PASS_RATES = f"""outcomes AS (
  SELECT {run_keys("(event_id % nd)")}, value FROM events, dims),
pass_rates AS (
  SELECT run_id, sample_id, model, CAST(count(*) FILTER (value < 60) AS BIGINT) AS test_passed,
         CAST(count(*) AS BIGINT) AS test_total,
         round(count(*) FILTER (value < 60) / count(*), 4) AS pass_rate
  FROM outcomes GROUP BY ALL)"""


def extraction(source: str, key: str, text: str, out: str) -> str:
    """CTE of the first function of each text."""
    return f"""x1 AS (
  SELECT {key}, replace(regexp_replace({text}, '{FENCE}', '', 'g'), '```', '') AS t FROM {source}),
x2 AS (SELECT {key}, t, string_split(t, chr(10)) AS lines FROM x1),
x3 AS (SELECT *, coalesce(list_position(
         list_transform(lines, lambda x: starts_with(ltrim(x, '{WS}'), 'def ')), true), 0) AS start FROM x2),
x4 AS (SELECT *, length(lines[start]) - length(ltrim(lines[start], '{WS}')) AS base, lines[start + 1:] AS rest FROM x3),
x5 AS (SELECT *, coalesce(list_position(list_transform(rest, lambda x:
         ltrim(x, '{WS}') <> '' AND length(x) - length(ltrim(x, '{WS}')) <= base), true), 0) AS stop FROM x4),
{out} AS (
  SELECT {key}, CASE WHEN start = 0 THEN {strip("t")}
    ELSE {strip("array_to_string(list_concat([lines[start]], CASE WHEN stop = 0 THEN rest ELSE rest[1:stop - 1] END), chr(10))")}
    END AS generated FROM x5)"""


def unquoted(text: str) -> str:
    """Docstring without fences and outer quotes."""
    t = f"replace(regexp_replace({strip(text)}, '{FENCE}', '', 'g'), '```', '')"
    patterns = (
        r'(?s)^"""(?:(.*)"""|"{0,2})$',
        r"(?s)^'''(?:(.*)'''|'{0,2})$",
        r'(?s)^"(?:(.*)"|)$',
        r"(?s)^'(?:(.*)'|)$",
    )
    for p in patterns:
        t = f"regexp_replace({t}, {lit(p)}, '\\1')"
    return strip(t)


RAW = """raw_responses AS (
  SELECT doc_id, CASE doc_id % 7
    WHEN 0 THEN concat('no function here ', source, ' ')
    WHEN 1 THEN concat('Sure.', chr(10), '```python', chr(10), 'def f_', lang, '(x):', chr(10), '    y = x', chr(10), chr(10), '    return y', chr(10), '```', chr(10), 'Done')
    WHEN 2 THEN concat('class A:', chr(10), '    def g(self):', chr(10), '        return ''', source, '''', chr(10), '    z = 2')
    WHEN 3 THEN concat('def h():', chr(10), '    return ''', lang, '''', chr(10), '# note', chr(10), 'def k():', chr(10), '    return 2')
    WHEN 4 THEN concat('\"\"\"Doc ', lang, '.\"\"\"')
    WHEN 5 THEN concat('```python', chr(10), '\"\"\"Doc ', source, '.\"\"\"', chr(10), '```')
    ELSE concat('''', text, '''') END AS raw
  FROM documents)"""


def ngrams(source: str, key: str, text: str, prefix: str) -> str:
    """CTEs <prefix>_len (token counts) and <prefix>_cnt (n-gram counts) per key."""
    grams = " UNION ALL ".join(
        f"SELECT {key}, {n} AS n, g{n} AS gram FROM {prefix}_win WHERE g{n} IS NOT NULL" for n in (1, 2, 3, 4)
    )
    over = f"OVER (PARTITION BY {key} ORDER BY i)"
    return f"""{prefix}_tok AS (SELECT {key}, {tok(text)} AS t FROM {source}),
{prefix}_len AS (SELECT {key}, len(t) AS n_tokens FROM {prefix}_tok),
{prefix}_pos AS (SELECT {key}, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM {prefix}_tok),
{prefix}_win AS (
  SELECT {key}, w AS g1, w || ' ' || lead(w, 1) {over} AS g2,
         w || ' ' || lead(w, 1) {over} || ' ' || lead(w, 2) {over} AS g3,
         w || ' ' || lead(w, 1) {over} || ' ' || lead(w, 2) {over} || ' ' || lead(w, 3) {over} AS g4
  FROM {prefix}_pos),
{prefix}_cnt AS (SELECT {key}, n, gram, count(*) AS cnt FROM ({grams}) GROUP BY ALL)"""


def bleu_ctes(source: str, text: str) -> str:
    """CTE bleu_scores (gen_id, bleu) of a table with gen_id and sample_id."""
    logp = " + ".join(
        f"""CASE WHEN h.n_tokens - {n - 1} <= 0 THEN ln(1e-9)
             WHEN coalesce(m{n}, 0) = 0 THEN ln(1.0::DOUBLE / (2 * (h.n_tokens - {n - 1})))
             ELSE ln(m{n}::DOUBLE / (h.n_tokens - {n - 1})) END"""
        for n in (1, 2, 3, 4)
    )
    clips = ", ".join(f"sum(least(a.cnt, b.cnt)) FILTER (a.n = {n}) AS m{n}" for n in (1, 2, 3, 4))
    return f"""{ngrams(source, "gen_id", text, "h")},
{ngrams("benchmark", "item_id", "text", "r")},
clipped AS (
  SELECT a.gen_id, {clips}
  FROM h_cnt a JOIN {source} g USING (gen_id)
  JOIN r_cnt b ON b.item_id = g.sample_id AND b.n = a.n AND b.gram = a.gram GROUP BY 1),
bleu_scores AS (
  SELECT g.gen_id, g.sample_id, CASE WHEN h.n_tokens = 0 OR r.n_tokens = 0 THEN 0.0::DOUBLE ELSE
    round(least(1.0::DOUBLE, exp(1 - r.n_tokens::DOUBLE / h.n_tokens)) * exp(({logp}) / 4), 4) END AS bleu
  FROM {source} g JOIN h_len h USING (gen_id) JOIN r_len r ON r.item_id = g.sample_id
  LEFT JOIN clipped USING (gen_id))"""


SCORE = "coalesce(TRY_CAST(nullif(regexp_extract(judge_response, '[1-5]'), '') AS INTEGER), 0)"

# Result records of all runs, skipped ones included.
FILLED = ",\n".join(
    [
        DIMS,
        GENERATIONS,
        SAMPLES,
        PASS_RATES,
        extraction("generations", "gen_id", "raw_response", "extracted"),
        f"""cleaned AS (
  SELECT g.*, CASE WHEN task = 'code_generation' THEN e.generated ELSE {unquoted("raw_response")} END AS generated
  FROM generations g JOIN extracted e USING (gen_id))""",
        bleu_ctes("cleaned", "generated"),
        f"""records AS (
  SELECT c.run_id, c.sample_id, c.model, c.raw_response, c.generated, b.bleu, {SCORE} AS quality_score,
         round(e.value, 1) AS latency_ms, round(c.memory_mb, 1) AS memory_mb
  FROM cleaned c JOIN bleu_scores b USING (gen_id) JOIN events e ON e.event_id = c.gen_id),
filled AS (
  SELECT s.run_id, s.sample_id, m.model, s.task, s.function_name, s.code,
         coalesce(r.generated, '') AS generated,
         CASE WHEN r.model IS NULL THEN 0 ELSE coalesce(p.test_passed, 0) END AS test_passed,
         CASE WHEN r.model IS NULL THEN 0 ELSE coalesce(p.test_total, 0) END AS test_total,
         CASE WHEN r.model IS NULL THEN 0 ELSE coalesce(p.pass_rate, 0) END AS pass_rate,
         coalesce(r.bleu, 0) AS bleu, coalesce(r.quality_score, 0) AS quality_score,
         coalesce(r.latency_ms, 0) AS latency_ms, coalesce(r.memory_mb, 0) AS memory_mb,
         coalesce(r.raw_response, 'SKIPPED (no API key)') AS raw_response
  FROM run_samples s CROSS JOIN (VALUES ('candidate'), ('base'), ('cloud')) m(model)
  LEFT JOIN records r USING (run_id, sample_id, model)
  LEFT JOIN pass_rates p USING (run_id, sample_id, model))""",
    ]
)


def mean(value: str, keep: str) -> str:
    total = f"CAST(sum(CAST({value} AS DECIMAL(24,4))) FILTER ({keep}) AS DOUBLE)"
    return f"round(coalesce({total} / nullif(count(*) FILTER ({keep}), 0), 0), 4)"


CODE, DOC = "task = 'code_generation'", "task = 'docstring_generation'"
MEANS = dict(
    zip(
        s.METRICS,
        (
            mean("pass_rate", CODE),
            mean("bleu", CODE),
            mean("quality_score", CODE),
            mean("bleu", DOC),
            mean("quality_score", DOC),
            f"round({mean('latency_ms', 'true')}, 1)",
            f"round({mean('memory_mb', 'memory_mb > 0')}, 1)",
        ),
    )
)


def metrics(by: str) -> str:
    columns = ", ".join(f'{sql} AS "{name}"' for name, sql in MEANS.items())
    return f"metrics AS (SELECT {by}, {columns} FROM filled GROUP BY ALL)"


def long_metrics(by: str) -> str:
    rows = " UNION ALL ".join(f"SELECT {by}, '{m}' AS metric, \"{m}\" AS value FROM metrics" for m in s.METRICS)
    return f"long_metrics AS ({rows})"


# Read several times below: computed once.
RUN_METRICS = re.sub(
    r"\b(filled|metrics|long_metrics) AS \(",
    r"\1 AS MATERIALIZED (",
    ",\n".join([FILLED, metrics("run_id, model"), long_metrics("run_id, model")]),
)

GATE = f"""{RUN_METRICS},
gate AS (
  SELECT n.run_id, n.model, n.metric, coalesce(o.value, 0) AS old, n.value AS new,
         CASE WHEN n.value = 0 THEN 'skipped' WHEN n.value < coalesce(o.value, 0) - 0.02::DOUBLE THEN 'regression'
              ELSE 'ok' END AS status
  FROM long_metrics n LEFT JOIN long_metrics o
    ON o.run_id + 1 = n.run_id AND o.model = n.model AND o.metric = n.metric
  WHERE n.metric IN ({", ".join(lit(m) for m in s.GATE_METRICS)})),
verdict AS (SELECT run_id, model, bool_and(status <> 'regression') AS passed FROM gate GROUP BY ALL)"""

FEEDBACK = """feedback_raw AS (
  SELECT event_id, concat('feedback_', CAST(CAST(ts AS DATE) AS VARCHAR), '.csv') AS file, ts,
         strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp,
         CASE WHEN user_id % 3 = 0 THEN 'task_1' ELSE 'task_2' END AS task,
         event_type AS prompt, props AS response,
         CASE WHEN event_id % 97 = 0 THEN 'n/a' WHEN event_id % 89 = 0 THEN '1.0' WHEN event_id % 83 = 0 THEN ' 1 '
              WHEN event_id % 79 = 0 THEN '1_0' WHEN event_id % 73 = 0 THEN '' WHEN value < 40 THEN '1' ELSE '0' END AS rating_raw
  FROM events),
feedback AS (
  SELECT *, CAST(replace(trim(rating_raw), '_', '') AS BIGINT) AS rating FROM feedback_raw
  WHERE regexp_matches(rating_raw, '^\\s*[+-]?[0-9]+(_[0-9]+)*\\s*$'))"""

FEEDBACK_TEXT = f"""CASE WHEN task = 'task_1' THEN concat('Generate code: ', prompt, chr(10), 'Code: ', response)
  ELSE concat('Generate docstring: ', prompt, chr(10), 'Docstring: ', response) END"""

EVAL = """cases AS (
  SELECT event_id // 4 AS id, event_id % 4 AS case_idx, props,
         concat('[', CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), ',"', event_type, '"]') AS input,
         CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR)
              WHEN 1 THEN CASE WHEN value < 50 THEN 'true' ELSE 'false' END
              ELSE concat('"', event_type, '"') END AS expected
  FROM events)"""

DOCUMENT_PAIRS = """document_pairs AS (
  SELECT doc_id AS ord, CASE doc_id % 10 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS split_rank, text AS prompt,
         source AS answer, len(string_split(text, ' ')) + len(string_split(source, ' ')) AS pieces
  FROM documents)"""


def vocab(*texts: str) -> str:
    """CTE vocab over SELECTs of one text column t."""
    words = " UNION ALL ".join(f"SELECT unnest({tok('t')}) AS token FROM ({x})" for x in texts)
    return f"""vocab AS (
  SELECT token, CAST(count(*) AS BIGINT) AS cnt,
         CAST(row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS INTEGER) AS id
  FROM ({words}) GROUP BY token ORDER BY cnt DESC, token LIMIT {q.VOCAB})"""


def ids(source: str, key: str, text: str, out: str) -> str:
    """CTE of id lists of a text column; a text without tokens gives an empty list."""
    return f"""{out} AS (
  SELECT s.{key}, coalesce(l.ids, []) AS {out} FROM {source} s LEFT JOIN (
    SELECT {key}, list(coalesce(v.id, 0) ORDER BY i) AS ids
    FROM (SELECT {key}, unnest(t) AS token, generate_subscripts(t, 1) AS i
          FROM (SELECT {key}, {tok(text)} AS t FROM {source})) w
    LEFT JOIN vocab v USING (token) GROUP BY 1) l USING ({key}))"""


DOCUMENT_IDS = ",\n".join([vocab("SELECT text AS t FROM documents"), ids("documents", "doc_id", "text", "input_ids")])

EXAMPLES = ",\n".join(
    [
        PAIRS,
        f"texts AS (SELECT ex_id, task, {prompt_sql('task', 'prompt')} AS model_input, answer FROM pairs)",
        vocab("SELECT model_input AS t FROM texts", "SELECT answer AS t FROM texts"),
        ids("texts", "ex_id", "model_input", "prompt_ids"),
        ids("texts", "ex_id", "answer", "answer_ids"),
        """examples AS (
  SELECT ex_id, task, prompt_ids || answer_ids || [1] AS input_ids,
         list_transform(prompt_ids || answer_ids || [1], lambda x: 1) AS attention_mask,
         list_transform(prompt_ids, lambda x: -100) || answer_ids || [1] AS labels
  FROM texts JOIN prompt_ids USING (ex_id) JOIN answer_ids USING (ex_id))""",
    ]
)


def split_of(source: str, key: str, group: str) -> str:
    """CTE parts: exact seeded split of a table."""
    return f"""parts AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY {group} ORDER BY md5('42|' || CAST({key} AS VARCHAR)), {key})
       <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY {group})) THEN 'train' ELSE 'validation' END AS part
  FROM {source})"""


def judge_sql() -> str:
    def fill(parts: tuple[str, ...]) -> str:
        a, b, c, d = (lit(p) for p in parts)
        return f"concat({a}, model, {b}, reference, {c}, raw_response, {d})"

    return f"CASE WHEN {CODE} THEN {fill(prompts.JUDGE_CODE)} ELSE {fill(prompts.JUDGE_DOCSTRING)} END"


def per_model(value: str, name: str = "{m}") -> str:
    return ", ".join(f"max({value}) FILTER (model = '{m}') AS {name.format(m=m)}" for m in s.MODELS)


def results_parts() -> str:
    stored = "CASE WHEN length(raw_response) > 500 THEN concat(substr(raw_response, 1, 500), '...') ELSE raw_response END"
    none, number = "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)"
    rows = [
        f"SELECT 'config' AS part, 'num_samples' AS key, CAST(count(*) AS DOUBLE) AS value, {none} AS text FROM run_samples",
        f"SELECT 'config', key, {number}, text FROM (VALUES ('base_model', 'base-model'), ('adapters', 'task_1,task_2'), ('judge_model', NULL)) c(key, text)",
        f"SELECT 'metrics', concat(model, '.', metric), value, {none} FROM long_metrics",
        f"SELECT 'results', concat(run_id, '.', sample_id, '.', model), CAST(bleu AS DOUBLE), {stored} FROM filled",
    ]
    return " UNION ALL ".join(rows)


PADDED = ", ".join(
    f"""array_to_string(list_transform({c} || list_transform(range(max_len - len(input_ids)), lambda x: {v}),
        lambda x: CAST(x AS VARCHAR)), ' ') AS {c}"""
    for c, v in (("input_ids", 0), ("attention_mask", 0), ("labels", -100))
)

SQL: dict[str, str] = {
    "union_splits": with_(PAIRS)
    + """SELECT ex_id, task, prompt, answer, split, ex_id AS ord,
         CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS split_rank FROM pairs""",
    "project_pairs": with_(PAIRS) + "SELECT ex_id, task, prompt, answer FROM pairs",
    "pairs_csv_roundtrip": with_(PAIRS) + "SELECT ex_id, task, prompt, answer FROM pairs",
    "examples_parquet_roundtrip": with_(EXAMPLES, split_of("examples", "ex_id", "task"))
    + f"SELECT ex_id, task, part, {shown('input_ids')}, {shown('attention_mask')}, {shown('labels')} FROM parts",
    "load_eval_set": with_(EVAL)
    + """SELECT id, CASE WHEN id % 2 = 0 THEN 'code_generation' ELSE 'docstring_generation' END AS task,
         CASE WHEN id % 2 = 0 THEN arg_min(props, case_idx) END AS prompt,
         CASE WHEN id % 2 = 0 THEN concat('fn_', CAST(id AS VARCHAR)) END AS function_name,
         CASE WHEN id % 2 = 0 THEN concat('def fn_', CAST(id AS VARCHAR), '(x):', chr(10), '    return x') END AS reference_code,
         CASE WHEN id % 2 = 0 THEN CAST(count(*) AS INTEGER) ELSE 0 END AS n_cases,
         CASE WHEN id % 2 = 1 THEN concat('def fn_', CAST(id AS VARCHAR), '(x):', chr(10), '    return x') END AS code,
         CASE WHEN id % 2 = 1 THEN concat('Returns ', arg_min(props, case_idx)) END AS reference_docstring
       FROM cases GROUP BY id""",
    "explode_test_cases": with_(EVAL)
    + """SELECT id, CAST(case_idx AS INTEGER) AS case_idx, input, expected FROM (
         SELECT *, regexp_replace(regexp_replace(i0, '(\\.[0-9]*[1-9])0+,', '\\1,'), '\\.0+,', ',') AS input
         FROM (SELECT id, case_idx, input AS i0, expected FROM cases WHERE id % 2 = 0))""",
    "load_feedback_csv": with_(FEEDBACK)
    + "SELECT file, timestamp, task, prompt, response, rating_raw FROM feedback_raw",
    "feedback_json_sink": with_(FEEDBACK)
    + f"""SELECT 'all_feedback' AS output, timestamp, task, prompt, response, rating, NULL AS text FROM feedback
       UNION ALL SELECT 'training_pairs', NULL, task, NULL, NULL, NULL, {FEEDBACK_TEXT} FROM feedback WHERE rating = 1""",
    "results_json_sink": with_(FILLED, metrics("model"), long_metrics("model")) + results_parts(),
    "length_filter": with_(DOCUMENT_PAIRS)
    + "SELECT ord, answer, CAST(pieces AS INTEGER) AS pieces FROM document_pairs WHERE pieces < 600",
    "first_n": with_(DOCUMENT_PAIRS)
    + f"""SELECT CAST(split_rank AS INTEGER) AS split_rank, ord, prompt FROM document_pairs WHERE pieces < 600
        ORDER BY split_rank, ord LIMIT {q.FIRST}""",
    "sample_per_task": with_(DIMS, GENERATIONS)
    + f"""SELECT gen_id, task, model FROM generations
        QUALIFY row_number() OVER (PARTITION BY task ORDER BY gen_id) <= {q.PER_TASK}""",
    "truncate_tokens": with_(DOCUMENT_IDS)
    + f"""SELECT doc_id, array_to_string(list_transform(input_ids[1:{s.APP_TOKEN_LIMIT}], lambda x: CAST(x AS VARCHAR)), ' ') AS input_ids,
         array_to_string(list_transform(input_ids[1:{s.APP_TOKEN_LIMIT}], lambda x: '1'), ' ') AS attention_mask,
         CAST(len(input_ids[1:{s.EVAL_TOKEN_LIMIT}]) AS INTEGER) AS n_eval
       FROM input_ids""",
    "truncate_response": """SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(substr(text, 1, 500), '...')
         ELSE text END AS raw_response FROM documents""",
    "format_prompt": with_(
        PAIRS,
        """p AS (SELECT ex_id, CASE WHEN ex_id % 7 = 0 THEN 'other' ELSE task END AS task,
          concat(' ', chr(9), prompt, chr(10)) AS prompt FROM pairs)""",
    )
    + f"""SELECT ex_id, task, {prompt_sql("task", "prompt")} AS model_input,
         {prompt_sql("task", strip("prompt"))} AS app_input FROM p""",
    "build_vocab": with_(vocab("SELECT text AS t FROM documents")) + "SELECT token, cnt, id FROM vocab",
    "encode_tokens": with_(DOCUMENT_IDS)
    + f"""SELECT doc_id, CAST(len(input_ids) AS INTEGER) AS n_tokens,
         CAST(len(list_filter(input_ids, lambda x: x = 0)) AS INTEGER) AS n_unknown, {shown("input_ids")} FROM input_ids""",
    "assemble_examples": with_(EXAMPLES)
    + f"SELECT ex_id, task, {shown('input_ids')}, {shown('attention_mask')}, {shown('labels')} FROM examples",
    "max_length": with_(EXAMPLES)
    + "SELECT task, CAST(max(len(input_ids)) AS INTEGER) AS max_len FROM examples GROUP BY task",
    "pad_right": with_(EXAMPLES, "longest AS (SELECT task, max(len(input_ids)) AS max_len FROM examples GROUP BY task)")
    + f"SELECT ex_id, task, {PADDED} FROM examples JOIN longest USING (task)",
    "exact_split": with_(split_of("events", "event_id", "event_type"))
    + "SELECT event_id, event_type, part FROM parts",
    "split_counts": with_(PAIRS, split_of("pairs", "ex_id", "task"))
    + "SELECT task, split, part, CAST(count(*) AS BIGINT) AS n_rows FROM parts GROUP BY ALL",
    "chat_prompts": with_(DIMS, GENERATIONS)
    + f"""SELECT gen_id, CASE WHEN {CODE} THEN concat({lit(prompts.CHAT_CODE)}, raw_response)
         ELSE concat({lit(prompts.CHAT_DOCSTRING)}, raw_response) END AS chat_prompt FROM generations""",
    "judge_prompts": with_(DIMS, GENERATIONS)
    + f"""SELECT gen_id, {judge_sql()} AS judge_prompt FROM (
         SELECT g.*, b.text AS reference FROM generations g JOIN benchmark b ON b.item_id = g.sample_id)""",
    "extract_function": with_(RAW, extraction("raw_responses", "doc_id", "raw", "extracted"))
    + "SELECT doc_id, generated FROM extracted",
    "clean_docstring": with_(RAW) + f"SELECT doc_id, {unquoted('raw')} AS generated FROM raw_responses",
    "function_name": with_(RAW)
    + """SELECT doc_id, coalesce(nullif(regexp_extract(raw, 'def ([\\p{L}\\p{N}_]+)', 1), ''),
         concat('sample_', CAST(doc_id AS VARCHAR))) AS "function" FROM raw_responses""",
    "tokenize_text": f"""SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS tokens
       FROM (SELECT doc_id, {tok("text")} AS tokens FROM documents)""",
    "ngram_counts": with_(ngrams("documents", "doc_id", "text", "d"))
    + """SELECT doc_id, n, CAST(count(*) AS BIGINT) AS n_distinct, CAST(sum(cnt) AS BIGINT) AS n_total,
         CAST(max(cnt) AS INTEGER) AS max_cnt, CAST(sum(cnt * length(gram)) AS BIGINT) AS weighted_length,
         CAST(sum(cnt * cnt) AS BIGINT) AS squared_cnt, CAST(sum(ascii(gram) * cnt) AS BIGINT) AS weighted_first
       FROM d_cnt GROUP BY doc_id, n""",
    "bleu": with_(DIMS, GENERATIONS, bleu_ctes("generations", "raw_response"))
    + "SELECT gen_id, sample_id, bleu FROM bleu_scores",
    "parse_judge_score": with_(DIMS, GENERATIONS)
    + f"SELECT gen_id, judge_response, {SCORE} AS quality_score FROM generations",
    "test_pass_rate": with_(DIMS, SAMPLES, PASS_RATES)
    + """SELECT s.run_id, s.sample_id, m.model, coalesce(test_passed, 0) AS test_passed,
         coalesce(test_total, 0) AS test_total, coalesce(pass_rate, 0) AS pass_rate
       FROM run_samples s CROSS JOIN (VALUES ('candidate'), ('base'), ('cloud')) m(model)
       LEFT JOIN pass_rates p USING (run_id, sample_id, model)""",
    "fill_skipped": with_(FILLED)
    + """SELECT run_id, sample_id, model, task, generated, test_passed, test_total, pass_rate, bleu, quality_score,
         latency_ms, memory_mb, raw_response FROM filled""",
    "assemble_results": with_(FILLED)
    + f"""SELECT run_id, sample_id, task, coalesce(function_name, '') AS function_name, coalesce(code, '') AS code,
         {per_model("bleu", "{m}_bleu")}, {per_model("pass_rate", "{m}_pass_rate")},
         {per_model("quality_score", "{m}_quality_score")}, {per_model("generated", "{m}_generated")}
       FROM filled GROUP BY run_id, sample_id, task, function_name, code""",
    "regression_gate": with_(GATE)
    + "SELECT run_id, model, metric, old, new, status, passed FROM gate JOIN verdict USING (run_id, model)",
    "promote_baseline": with_(GATE)
    + """SELECT run_id, model, metric, value, 'new' AS origin FROM long_metrics JOIN verdict USING (run_id, model) WHERE passed
       UNION ALL SELECT o.run_id + 1, o.model, o.metric, o.value, 'old' FROM long_metrics o
       JOIN verdict v ON v.run_id = o.run_id + 1 AND v.model = o.model WHERE NOT passed""",
    "params_diff": """WITH params AS (
         SELECT CAST(ts AS DATE) - DATE '2024-01-01' AS run_id,
                concat('training.', event_type, '.', CAST(user_id AS VARCHAR)) AS key, max(props) AS value
         FROM events GROUP BY 1, 2)
       SELECT coalesce(o.run_id + 1, n.run_id) AS run_id, coalesce(o.key, n.key) AS key, o.value AS old, n.value AS new,
              CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'changed' END AS change
       FROM params o FULL JOIN params n ON n.run_id = o.run_id + 1 AND n.key = o.key
       WHERE o.value IS DISTINCT FROM n.value""",
    "metrics_diff": with_(RUN_METRICS)
    + """SELECT coalesce(o.run_id + 1, n.run_id) AS run_id, coalesce(o.model, n.model) AS model,
         coalesce(o.metric, n.metric) AS metric, o.value AS old, n.value AS new, round(n.value - o.value, 4) AS delta
       FROM long_metrics o FULL JOIN long_metrics n
         ON n.run_id = o.run_id + 1 AND n.model = o.model AND n.metric = o.metric""",
    "compute_metrics": with_(FILLED, metrics("model")) + "SELECT * FROM metrics",
    "metrics_table": with_(FILLED, metrics("model"), long_metrics("model"))
    + f"SELECT metric, {per_model('value')} FROM long_metrics GROUP BY metric",
    "per_sample_report": with_(
        FILLED,
        f"""lines AS (SELECT run_id, sample_id, task, model,
         CASE WHEN {CODE} THEN coalesce(function_name, '')
              ELSE coalesce(nullif(regexp_extract(code, 'def ([\\p{{L}}\\p{{N}}_]+)', 1), ''),
                            concat('sample_', CAST(sample_id AS VARCHAR))) END AS "function",
         CASE WHEN {CODE} THEN concat(CAST(test_passed AS VARCHAR), '/', CAST(test_total AS VARCHAR), ' (',
                CAST(CAST(round_even(pass_rate * 100, 0) AS BIGINT) AS VARCHAR), '%)')
              ELSE printf('%.4f', bleu) END AS line FROM filled)""",
    )
    + f"""SELECT run_id, sample_id, task, "function", {per_model("line")} FROM lines GROUP BY ALL""",
    "run_record": with_(PAIRS, split_of("pairs", "ex_id", "task"))
    + """SELECT 'run-1' AS run_id, concat(task, CASE part WHEN 'train' THEN '.train_samples' ELSE '.eval_samples' END) AS key,
         CAST(count(*) AS VARCHAR) AS value FROM parts GROUP BY task, part
       UNION ALL SELECT 'run-1', * FROM (VALUES ('git_hash', 'abc1234'), ('base_model', 'base-model'),
         ('hyperparameters.lora_r', '4'), ('hyperparameters.lora_dropout', '0.1'),
         ('task_1.target_modules[0]', 'att_q'), ('task_1.target_modules[1]', 'att_o'),
         ('task_2.target_modules[0]', 'mlp_up'), ('task_2.target_modules[1]', 'mlp_down')) v(key, value)""",
    "parse_feedback": with_(FEEDBACK) + "SELECT event_id, file, task, prompt, response, rating FROM feedback",
    "feedback_summary": with_(FEEDBACK)
    + """SELECT total, positive, total - positive AS negative,
         CAST(round_even(positive / total * 100, 0) AS BIGINT) AS positive_pct,
         CAST(round_even((total - positive) / total * 100, 0) AS BIGINT) AS negative_pct, task_1, total - task_1 AS task_2
       FROM (SELECT count(*) AS total, count(*) FILTER (rating = 1) AS positive,
                    count(*) FILTER (task = 'task_1') AS task_1 FROM feedback) WHERE total > 0""",
    "feedback_pairs": with_(FEEDBACK) + f"SELECT task, {FEEDBACK_TEXT} AS text FROM feedback WHERE rating = 1",
    "feedback_append_stream": """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS prompt,
         CASE WHEN value < 40 THEN 1 ELSE 0 END AS rating FROM events""",
    "feedback_daily_counts": with_(FEEDBACK)
    + "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, task, count(*) AS n_rows FROM feedback GROUP BY ALL",
    "encode_lossless": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "feedback_incremental": with_(FEEDBACK)
    + """SELECT file, timestamp, task, prompt, response, rating, CAST(NULL AS VARCHAR) AS reason FROM feedback
       UNION ALL SELECT file, timestamp, task, prompt, response, NULL, 'rating' FROM feedback_raw
       WHERE event_id NOT IN (SELECT event_id FROM feedback)""",
    "feedback_daily_stream": with_(FEEDBACK)
    + "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, task, count(*) AS n_rows FROM feedback GROUP BY ALL",
    "read_results": with_(FILLED, metrics("model"), long_metrics("model"))
    + "SELECT model, metric, value FROM long_metrics WHERE value IS NOT NULL",
    "baseline_store": with_(
        FILLED,
        metrics("model"),
        long_metrics("model"),
        f"""judged AS (
  SELECT n.model AS new, o.model AS old,
         bool_and(coalesce(n.value, 0) = 0 OR coalesce(n.value, 0) >= coalesce(o.value, 0) - 0.02::DOUBLE) AS ok
  FROM long_metrics n JOIN long_metrics o USING (metric)
  WHERE metric IN ({", ".join(lit(m) for m in s.GATE_METRICS)}) GROUP BY ALL)""",
        "second AS (SELECT ok AS ok2 FROM judged WHERE new = 'base' AND old = 'candidate')",
        """third AS (SELECT ok AS ok3 FROM judged, second
  WHERE new = 'cloud' AND old = CASE WHEN ok2 THEN 'base' ELSE 'candidate' END)""",
        """versions AS (
  SELECT 'candidate' AS model, 1 AS version UNION ALL SELECT 'base', 2 FROM second WHERE ok2
  UNION ALL SELECT 'cloud', CASE WHEN ok2 THEN 3 ELSE 2 END FROM second, third WHERE ok3)""",
    )
    + """SELECT CAST(version AS BIGINT) AS version, metric, value FROM versions JOIN long_metrics USING (model)
       WHERE value IS NOT NULL""",
    "run_store": with_(RUN_METRICS) + "SELECT run_id, model, metric, value FROM long_metrics",
}
