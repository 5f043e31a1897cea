"""The registered queries once more, as SQL for a second engine."""

from __future__ import annotations

from tagwright.functions.text import WHITESPACE
from tagwright.sources.tables import VERDICT_TASK

_BLANKS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)

# 0.8 of 2**32 in hex: hashes below it are in the training part.
_SHARE = "cccccccc"


def _strip(expression: str) -> str:
    return f"trim({expression}, {_BLANKS})"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _split(id_column: str) -> str:
    return f"CASE WHEN md5('raw:' || {id_column}) < '{_SHARE}' THEN 'train' ELSE 'test' END"


_PART = f"""CASE WHEN split = 'test' THEN 'test'
  WHEN md5('42:' || example_id) < '{_SHARE}' THEN 'train' ELSE 'validation' END"""

_LANGUAGE = f"""language AS (
  SELECT doc_id AS example_id, {_strip("text")} AS symptoms, lang AS diagnosis, {_split("doc_id")} AS split
  FROM documents)"""

_LABEL = """CASE WHEN toxic = 0 AND quality = 1 THEN 'clean' WHEN toxic = 0 THEN 'low quality'
  WHEN quality = 1 THEN 'toxic' WHEN quality = 0 THEN 'low quality toxic' END"""

_VERDICT = f"""verdict AS (
  SELECT d.doc_id AS example_id, {_strip("d.text")} AS symptoms, {_LABEL} AS diagnosis,
    {_split("d.doc_id")} AS split
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

_VERDICT_LEFT = _VERDICT.replace("verdict AS", "reviewed AS").replace("JOIN labels", "LEFT JOIN labels")

_PARTS = f"parts AS (SELECT example_id, symptoms, diagnosis, {_PART} AS part FROM verdict)"

_LABELS = "vocabulary AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_quote(label)})" for i, label in enumerate(VERDICT_TASK.ordered)
) + ") AS t(ord, label))"

# Most frequent training label.
_MAJORITY = """majority AS (
  SELECT example_id, part AS split, diagnosis AS actual,
    (SELECT diagnosis FROM parts WHERE part = 'train' GROUP BY diagnosis ORDER BY count(*) DESC, diagnosis LIMIT 1)
      AS predicted
  FROM parts)"""

# Naive Bayes over words, log weights in whole millionths.
_WORDS = r"""tokens AS (
  SELECT example_id, part, diagnosis, unnest(regexp_extract_all(lower(symptoms), '\p{L}+')) AS word FROM parts),
word_counts AS (SELECT word, diagnosis AS label, count(*) AS n FROM tokens WHERE part = 'train' GROUP BY ALL),
word_list AS (SELECT DISTINCT word FROM word_counts),
totals AS (
  SELECT ord, v.label, coalesce((SELECT sum(n) FROM word_counts c WHERE c.label = v.label), 0) AS total,
    (SELECT count(*) FROM word_list) AS size,
    (SELECT count(*) FROM parts WHERE part = 'train' AND diagnosis = v.label) AS n_rows,
    (SELECT count(*) FROM parts WHERE part = 'train') AS all_rows
  FROM vocabulary v),
priors AS (
  SELECT ord, label, round(ln((n_rows + 1)::DOUBLE / (all_rows + (SELECT count(*) FROM vocabulary))) * 1000000)::BIGINT
    AS prior FROM totals),
weights AS (
  SELECT w.word, t.ord, round(ln((coalesce(c.n, 0) + 1)::DOUBLE / (t.total + t.size)) * 1000000)::BIGINT AS weight
  FROM word_list w CROSS JOIN totals t LEFT JOIN word_counts c ON c.word = w.word AND c.label = t.label),
sums AS (
  SELECT example_id, ord, sum(weight) AS weight FROM tokens JOIN weights USING (word) GROUP BY ALL),
ranked AS (
  SELECT p.example_id, q.label, row_number() OVER (
    PARTITION BY p.example_id ORDER BY coalesce(s.weight, 0) + q.prior DESC, q.ord) AS place
  FROM parts p CROSS JOIN priors q LEFT JOIN sums s ON s.example_id = p.example_id AND s.ord = q.ord),
words AS (
  SELECT p.example_id, p.part AS split, p.diagnosis AS actual, r.label AS predicted
  FROM parts p JOIN ranked r ON r.example_id = p.example_id AND r.place = 1)"""

_WORD_SETS = r"""word_sets AS (
  SELECT example_id, part, diagnosis, list_distinct(regexp_extract_all(lower(symptoms), '\p{L}+')) AS words
  FROM parts)"""


def _demo_ids(name: str, salt: str, k: int, source: str = "parts WHERE part = 'train'") -> str:
    return f"""{name} AS (
  SELECT example_id, row_number() OVER (ORDER BY md5('{salt}:' || example_id)) AS ord FROM {source}
  QUALIFY ord <= {k})"""


def _similarity(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    either = f"(len({a}) + len({b}) - {common})"
    return f"CASE WHEN {either} = 0 THEN 0.0::DOUBLE ELSE {common}::DOUBLE / {either} END"


_NEAREST = _demo_ids("demo_ids", "labeled:42", 4) + f""",
nearest_ranked AS (
  SELECT r.example_id, r.part AS split, r.diagnosis AS actual, d.diagnosis AS predicted,
    row_number() OVER (PARTITION BY r.example_id ORDER BY {_similarity("r.words", "d.words")} DESC, i.ord) AS place
  FROM word_sets r CROSS JOIN demo_ids i JOIN word_sets d ON d.example_id = i.example_id),
nearest_demo AS (SELECT example_id, split, actual, predicted FROM nearest_ranked WHERE place = 1)"""

_CORRECT = "(actual = predicted)::INT::DOUBLE"

_WORDS_ALL = (_VERDICT, _PARTS, _LABELS, _WORDS)

_ALL_RUNS = (
    *_WORDS_ALL, _MAJORITY, _WORD_SETS, _NEAREST,
    f"""scored AS (
  SELECT 'majority' AS run_id, *, {_CORRECT} AS correct FROM majority UNION ALL
  SELECT 'nearest_demo', *, {_CORRECT} FROM nearest_demo UNION ALL
  SELECT 'words', *, {_CORRECT} FROM words)""",
    """run_metrics AS (
  SELECT run_id, split, 'accuracy' AS metric, sum(correct) / count(*) AS value FROM scored GROUP BY ALL UNION ALL
  SELECT run_id, split, 'num_examples', count(*)::DOUBLE FROM scored GROUP BY ALL UNION ALL
  SELECT run_id, split, 'disagreements', (count(*) FILTER (WHERE correct = 0))::DOUBLE FROM scored GROUP BY ALL)""",
)

_NUMBERED = """answers AS (
  SELECT example_id, split, diagnosis, CASE WHEN contains(diagnosis, 'toxic') THEN '1. ' || diagnosis
    ELSE upper(diagnosis) || ' ' END AS predicted FROM verdict)"""

_BY_SPLIT = "sum(correct) / count(*) AS accuracy, count(*) AS num_examples"


def _language_part(part: str) -> str:
    return _with(_LANGUAGE) + f"SELECT example_id, symptoms, diagnosis, split FROM language WHERE {part}"


_MARKED = """marked AS (SELECT example_id, CASE WHEN symptoms IS NULL THEN 'null_text'
  WHEN symptoms = '' THEN 'empty_text' WHEN diagnosis IS NULL THEN 'null_label'
  WHEN diagnosis NOT IN ('clean', 'low quality', 'toxic') THEN 'label_not_in_vocabulary' END AS problem
  FROM reviewed)"""


def _validation(ids: bool = True) -> str:
    repeated = ",\n  count(*) - count(DISTINCT example_id) AS repeated_ids" if ids else ""
    return _with(_VERDICT_LEFT, _MARKED) + f"""SELECT count(*) AS total,
  count(*) FILTER (WHERE problem = 'null_text') AS null_text,
  count(*) FILTER (WHERE problem = 'empty_text') AS empty_text,
  count(*) FILTER (WHERE problem = 'null_label') AS null_label,
  count(*) FILTER (WHERE problem = 'label_not_in_vocabulary') AS label_not_in_vocabulary,
  count(*) FILTER (WHERE problem IS NULL) AS valid,
  count(problem) AS rejected{repeated}
FROM marked"""


def _numeric(column: str) -> str:
    quartiles = ", ".join(f"round(quantile_cont({column}, {q / 100}), 6) AS q{q}" for q in (25, 50, 75))
    return f"""SELECT '{column}' AS column_name, count({column}) AS count, round(avg({column}), 6) AS mean,
  round(stddev_samp({column}), 6) AS std, min({column})::DOUBLE AS min, {quartiles}, max({column})::DOUBLE AS max
FROM documents"""


def _categorical(column: str) -> str:
    return f"""SELECT '{column}' AS column_name, (SELECT count({column}) FROM verdict) AS count,
  (SELECT count(DISTINCT {column}) FROM verdict) AS "unique", top, freq
FROM (SELECT {column} AS top, count(*) AS freq, min(example_id) AS first_id FROM verdict
  WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY freq DESC, first_id LIMIT 1)"""


# Prompts as they are to be, word by word.
_LANGUAGE_HEAD = """You sort entries for language identification. Read each entry and name the single most likely language.

Allowed values of language:
1. de
2. en
3. es
4. fr

Rules:
- """

_RULE = {
    "answer_only": "The whole reply is read as the answer, so give a list entry alone.",
    "structured": 'The reply is read as a JSON object whose key "diagnosis" holds a list entry.',
    "reasoned": 'The reply is read as a JSON object: the key "reasoning" holds your steps, '
    'the key "diagnosis" after it a list entry.',
}

_ORIGIN_PROMPT = """Guess.

Allowed values of origin:
1. europe
2. overseas

Rules:
- The whole reply is read as the answer, so give a list entry alone."""

_VERDICT_INSTRUCTIONS = (
    "You sort entries for content review. Read each entry and name the single most likely verdict."
)

_VERDICT_PROMPT = _VERDICT_INSTRUCTIONS + """

Allowed values of verdict:
1. clean
2. low quality
3. low quality toxic
4. toxic

Rules:
- """ + _RULE["reasoned"]


def _prompts() -> str:
    variants = [f"('language', '{s}', {_quote(_LANGUAGE_HEAD + rule)}, 'Document: ')" for s, rule in _RULE.items()]
    variants.append(f"('origin', 'answer_only', {_quote(_ORIGIN_PROMPT)}, 'Entry: ')")
    return _with(_LANGUAGE) + f"""SELECT example_id, task, style, system_prompt, label || symptoms AS user_prompt
FROM language CROSS JOIN (VALUES {", ".join(variants)}) AS t(task, style, system_prompt, label)"""


def _feedback(answer: str) -> str:
    listed = ", ".join(VERDICT_TASK.vocabulary)
    return f"""'Invalid verdict "' || {answer} || '". Must be one of: {listed}'"""


def _cues(max_retries: int) -> str:
    """The cue-word model: first answer, and the answer after feedback."""
    feedback = 'Invalid language "unknown". Must be one of: de, en, es, fr'
    first = "CASE " + " ".join(
        f"WHEN contains(message, '{cue}') THEN '{label}'"
        for cue, label in ((" les ", "fr"), (" der ", "de"), (" los ", "es"), (" the ", "en"))
    ) + " ELSE 'unknown' END"
    retry = f"first_answer = 'unknown' AND {max_retries} > 0"
    return f"""asked AS (
  SELECT example_id, diagnosis AS actual, {_PART} AS split, 'Document: ' || symptoms AS message FROM language),
answered AS (SELECT *, {first} AS first_answer FROM asked),
cues AS (
  SELECT example_id, actual, split,
    CASE WHEN {retry} THEN ' EN' ELSE first_answer END AS raw_output,
    CASE WHEN {retry} THEN 'EN' ELSE first_answer END AS predicted,
    CASE WHEN {retry} THEN 2 ELSE 1 END AS attempts,
    first_answer <> 'unknown' OR {max_retries} > 0 AS valid,
    (length(message) + CASE WHEN {retry} THEN length(message) + 2 + {len(feedback)} ELSE 0 END)::BIGINT
      AS prompt_tokens,
    (length(first_answer) + CASE WHEN {retry} THEN 3 ELSE 0 END)::BIGINT AS completion_tokens
  FROM answered)"""


_CUE_COLUMNS = "example_id, actual, split, raw_output, predicted, attempts, valid, prompt_tokens, completion_tokens"

_POOL = f"""pool AS (SELECT example_id FROM parts WHERE part = 'validation'
  QUALIFY row_number() OVER (ORDER BY md5('pool:42:' || example_id)) <= 100),
rounds AS (SELECT r.round, p.example_id FROM pool p CROSS JOIN (SELECT unnest(range(1, 7))::INT AS round) r
  QUALIFY row_number() OVER (PARTITION BY r.round ORDER BY md5('minibatch:42:' || r.round || ':' || example_id)) <= 35)"""

_CANDIDATES = f"""sets AS (
  SELECT c AS candidate_id, example_id, row_number() OVER (
    PARTITION BY c ORDER BY md5('labeled:42-' || c || ':' || example_id)) AS ord
  FROM parts CROSS JOIN (SELECT unnest(range(1, 7))::INT AS c) WHERE part = 'train' QUALIFY ord <= 4),
tried AS (
  SELECT s.candidate_id, r.example_id, r.diagnosis AS actual, d.diagnosis AS predicted,
    row_number() OVER (PARTITION BY s.candidate_id, r.example_id
      ORDER BY {_similarity("r.words", "d.words")} DESC, s.ord) AS place
  FROM word_sets r CROSS JOIN sets s JOIN word_sets d ON d.example_id = s.example_id
  WHERE r.part = 'validation'),
judged AS (SELECT candidate_id, example_id, {_CORRECT} AS correct FROM tried WHERE place = 1)"""

# After round 5 and after round 6 the leader not yet taken is scored on the pool.
_SEARCH = """running AS (
  SELECT candidate_id, sum(correct) FILTER (WHERE round <= 5) / count(*) FILTER (WHERE round <= 5) AS at_5,
    sum(correct) / count(*) AS at_6
  FROM judged JOIN rounds USING (example_id) GROUP BY candidate_id),
leader_5 AS (SELECT candidate_id FROM running ORDER BY at_5 DESC, candidate_id LIMIT 1),
leader_6 AS (SELECT candidate_id FROM running WHERE candidate_id NOT IN (SELECT candidate_id FROM leader_5)
  ORDER BY at_6 DESC, candidate_id LIMIT 1),
in_full AS (
  SELECT candidate_id, sum(correct) / count(*) AS full_accuracy, count(*) AS full_examples
  FROM judged JOIN pool USING (example_id)
  WHERE candidate_id IN (SELECT candidate_id FROM leader_5 UNION ALL SELECT candidate_id FROM leader_6)
  GROUP BY candidate_id)"""


# The proposing search: 3 shortest word lengths times 4 demonstration sets, 35 rows assumed beforehand, half a
# standard deviation of curiosity; 4 candidates, then 2 and 2, a leader in full after rounds 2 and 3.
_SPACE = """space AS (SELECT (i - 1) * 4 + s AS candidate_id, i AS instruction, s AS demo_set, [1, 4, 7][i] AS shortest
  FROM (SELECT unnest(range(1, 4))::INT AS i) CROSS JOIN (SELECT unnest(range(1, 5))::INT AS s))"""

_PROPOSED = f"""sets AS (
  SELECT c AS demo_set, example_id, row_number() OVER (
    PARTITION BY c ORDER BY md5('labeled:42-' || c || ':' || example_id)) AS ord
  FROM parts CROSS JOIN (SELECT unnest(range(1, 5))::INT AS c) WHERE part = 'train' QUALIFY ord <= 4),
long_words AS (SELECT w.example_id, w.diagnosis, l.shortest, list_filter(w.words, lambda x: length(x) >= l.shortest) AS words
  FROM word_sets w CROSS JOIN (SELECT unnest([1, 4, 7]) AS shortest) l),
tried AS (
  SELECT c.candidate_id, r.example_id, r.diagnosis AS actual, d.diagnosis AS predicted,
    row_number() OVER (PARTITION BY c.candidate_id, r.example_id
      ORDER BY {_similarity("r.words", "d.words")} DESC, s.ord) AS place
  FROM pool p JOIN long_words r ON r.example_id = p.example_id JOIN space c ON c.shortest = r.shortest
  JOIN sets s ON s.demo_set = c.demo_set JOIN long_words d ON d.example_id = s.example_id AND d.shortest = c.shortest),
judged AS (SELECT candidate_id, example_id, {_CORRECT} AS correct FROM tried WHERE place = 1)"""


def _surrogate(name: str, seen: str) -> str:
    """Expectation and promise of every candidate after the scores in ``seen(candidate_id, correct, n)``."""
    sums = ",\n".join(
        f"{name}_{part} AS (SELECT {part}, sum(correct) AS c, sum(n) AS n FROM {seen} JOIN space USING (candidate_id) GROUP BY {part})"
        for part in ("instruction", "demo_set")
    )
    drawn = " + ".join(f"(coalesce({p}.c, 0) - mean * coalesce({p}.n, 0)) / (coalesce({p}.n, 0) + 35.0)" for p in ("a", "b"))
    curious = " + ".join(f"1 / sqrt(coalesce({p}.n, 0) + 35.0)" for p in ("a", "b"))
    return f"""{sums},
{name}_base AS (
  SELECT candidate_id, mean + {drawn} AS base, 0.5 * ({curious}) AS curious
  FROM space CROSS JOIN (SELECT sum(correct) / sum(n) AS mean FROM {seen})
  LEFT JOIN {name}_instruction a USING (instruction) LEFT JOIN {name}_demo_set b USING (demo_set)),
{name} AS (
  SELECT candidate_id, base + (coalesce(correct, 0) - coalesce(n, 0) * base) / (coalesce(n, 0) + 35.0) AS expected, curious
  FROM {name}_base LEFT JOIN {seen} USING (candidate_id))"""


def _proposals() -> str:
    def minibatch(number: int) -> str:
        return f"""batch_{number} AS (SELECT {number} AS round, candidate_id, 'minibatch' AS kind, sum(correct) AS correct, count(*) AS n
  FROM judged JOIN rounds USING (example_id) JOIN picked_{number} USING (candidate_id) WHERE round = {number} GROUP BY candidate_id)"""

    def in_full(number: int, model: str, among: str) -> str:
        return f"""leader_{number} AS (SELECT candidate_id, expected FROM {model} WHERE candidate_id IN ({among})
  ORDER BY round(expected, 9) DESC, candidate_id LIMIT 1),
full_{number} AS (SELECT {number} AS round, candidate_id, 'pool' AS kind, sum(correct) AS correct, count(*) AS n
  FROM judged JOIN leader_{number} USING (candidate_id) GROUP BY candidate_id)"""

    def picked(number: int, model: str, tried: str) -> str:
        return f"""picked_{number} AS (SELECT candidate_id, expected FROM {model} WHERE candidate_id NOT IN ({tried})
  ORDER BY round(expected + curious, 9) DESC, candidate_id LIMIT 2)"""

    def seen(name: str, *tables: str, without: str | None = None) -> str:
        rows = [f"SELECT candidate_id, correct, n FROM {t}" for t in tables]
        if without:
            rows = [rows[0]] + [f"{r} WHERE candidate_id NOT IN (SELECT candidate_id FROM {without})" for r in rows[1:]]
        return f"{name} AS ({' UNION ALL '.join(rows)})"

    def ids(*tables: str) -> str:
        return " UNION ALL ".join(f"SELECT candidate_id FROM {t}" for t in tables)

    steps = [
        _SPACE, _PROPOSED,
        "picked_1 AS (SELECT candidate_id, NULL::DOUBLE AS expected FROM space WHERE candidate_id IN (1, 6, 11, 4))",
        minibatch(1), seen("seen_1", "batch_1"), _surrogate("model_1", "seen_1"),
        picked(2, "model_1", ids("batch_1")), minibatch(2), seen("seen_2", "batch_1", "batch_2"), _surrogate("model_2", "seen_2"),
        in_full(2, "model_2", ids("batch_1", "batch_2")),
        seen("seen_2f", "full_2", "batch_1", "batch_2", without="full_2"), _surrogate("model_2f", "seen_2f"),
        picked(3, "model_2f", ids("batch_1", "batch_2")), minibatch(3),
        seen("seen_3", "full_2", "batch_1", "batch_2", "batch_3", without="full_2"), _surrogate("model_3", "seen_3"),
        in_full(3, "model_3", ids("batch_1", "batch_2", "batch_3") + " EXCEPT SELECT candidate_id FROM full_2"),
        """recorded AS (
  SELECT b.*, expected FROM batch_1 b JOIN picked_1 USING (candidate_id)
  UNION ALL SELECT b.*, expected FROM batch_2 b JOIN picked_2 USING (candidate_id)
  UNION ALL SELECT b.*, expected FROM batch_3 b JOIN picked_3 USING (candidate_id)
  UNION ALL SELECT f.*, expected FROM full_2 f JOIN leader_2 USING (candidate_id)
  UNION ALL SELECT f.*, expected FROM full_3 f JOIN leader_3 USING (candidate_id))""",
    ]
    return _with(_VERDICT, _PARTS, _WORD_SETS, _POOL, *steps) + """SELECT round, candidate_id, kind, correct, n AS num_examples,
  round(expected, 6) AS expected, candidate_id = (SELECT candidate_id FROM (TABLE full_2 UNION ALL TABLE full_3)
    ORDER BY correct / n DESC, candidate_id LIMIT 1) AS winner FROM recorded"""


def _report() -> str:
    return _with(_VERDICT, _PARTS, _demo_ids("shown", "labeled:42", 7)) + f"""
SELECT 'OPTIMIZED PROMPT DETAILS' AS section, 0 AS ord, 'Task: verdict, style: reasoned' AS text
UNION ALL SELECT 'SIGNATURE-LEVEL INSTRUCTIONS', 0, {_quote(_VERDICT_INSTRUCTIONS)}
UNION ALL SELECT 'FEW-SHOT EXAMPLES', 0, 'Total examples: ' || count(*) FROM shown
UNION ALL SELECT 'FEW-SHOT EXAMPLES', ord::INT, 'Example ' || ord || ' (labeled): ' || symptoms || ' => ' || diagnosis
  FROM shown JOIN parts USING (example_id) WHERE ord <= 5
UNION ALL SELECT 'FEW-SHOT EXAMPLES', 6, '... and ' || (n - 5) || ' more examples'
  FROM (SELECT count(*) AS n FROM shown) WHERE n > 5
UNION ALL SELECT 'ACTUAL PROMPT EXAMPLE', 0, {_quote(_VERDICT_PROMPT)} || chr(10) || chr(10) || 'Document: ' || symptoms
  FROM parts WHERE example_id = (SELECT min(example_id) FROM parts WHERE part = 'train')"""


_RUN_TABLE = """sizes AS (SELECT count(*) FILTER (WHERE part = 'train') AS train_size,
  count(*) FILTER (WHERE part = 'validation') AS val_size FROM parts),
run_table AS (SELECT run_id, requires_training, 'local/' || run_id AS lm_model, train_size, val_size
  FROM sizes CROSS JOIN (VALUES ('majority', true), ('nearest_demo', true), ('words', true), ('column', false))
    AS t(run_id, requires_training))"""

_PARAMS = "\nUNION ALL ".join(
    f"SELECT run_id, '{c}' AS key, {c}::VARCHAR AS value FROM run_table"
    for c in ("requires_training", "lm_model", "train_size", "val_size")
)


def statements() -> dict[str, str]:
    words = _with(*_WORDS_ALL)
    runs = _with(*_ALL_RUNS)
    scored = f"SELECT *, {_CORRECT} AS correct FROM words"
    verdict = _with(_VERDICT)
    parts = _with(_VERDICT, _PARTS)
    return {
        "load_examples": _with(_LANGUAGE) + "SELECT *, diagnosis AS label FROM language",
        "split_train": _language_part(f"split = 'train' AND md5('42:' || example_id) < '{_SHARE}'"),
        "split_validation": _language_part(f"split = 'train' AND md5('42:' || example_id) >= '{_SHARE}'"),
        "split_test": _language_part("split = 'test'"),
        "all_splits": _language_part("true"),
        "dataset_info": _with(_LANGUAGE)
        + "SELECT split, count(*) AS num_rows, 'symptoms,diagnosis' AS features, 'documents' AS dataset FROM language GROUP BY split",
        "split_hash": _with(_LANGUAGE) + f"""SELECT example_id,
  CASE WHEN md5('42:' || example_id) < '{_SHARE}' THEN 'train' ELSE 'validation' END AS split
FROM language WHERE split = 'train'""",
        "split_exact": _with(_LANGUAGE) + """SELECT example_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || example_id))
    <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS split
FROM language WHERE split = 'train'""",
        "list_rows": _with(_LANGUAGE) + f"""SELECT *, count(*) OVER () AS total_rows FROM language
WHERE split = 'train' AND md5('42:' || example_id) < '{_SHARE}' ORDER BY example_id LIMIT 5""",
        "assign_ids": """SELECT md5(length(text) || ':' || text || length(lang) || ':' || lang) || '-' ||
  row_number() OVER (PARTITION BY text, lang) AS example_id, text AS symptoms, lang AS diagnosis FROM documents""",
        "trim_text": f"""SELECT doc_id AS example_id, length(padded)::INT AS padded_length, {_strip("padded")} AS symptoms
FROM (SELECT doc_id, '  ' || chr(9) || text || chr(10) || chr(12288) || chr(160) AS padded FROM documents)""",
        "normalize_label": verdict + f"""SELECT example_id, raw_label, lower({_strip("raw_label")}) AS label
FROM (SELECT example_id, ' ' || upper(diagnosis) || chr(9) || chr(10) AS raw_label FROM verdict)""",
        "label_vocabulary": verdict + """SELECT ord::INT AS ord, label, ord || '. ' || label AS line
FROM (SELECT label, row_number() OVER (ORDER BY label) AS ord FROM (SELECT DISTINCT diagnosis AS label FROM verdict))""",
        "validation_report": _validation(),
        "validation_observed": _validation(ids=False),
        "rejected_rows": _with(_VERDICT_LEFT, _MARKED)
        + "SELECT example_id, problem FROM marked WHERE problem IS NOT NULL",
        "invalid_labels": verdict + """SELECT example_id, diagnosis FROM verdict
WHERE diagnosis NOT IN ('clean', 'low quality', 'toxic')""",
        "vocab_coverage": """WITH declared AS (SELECT * FROM (VALUES ('en'), ('fr'), ('it')) AS t(label))
SELECT DISTINCT lang AS label, 'missing_from_vocabulary' AS problem FROM documents
WHERE lang NOT IN (SELECT label FROM declared)
UNION ALL SELECT label, 'missing_from_data' FROM declared WHERE label NOT IN (SELECT lang FROM documents)""",
        "row_conservation": _with(_LANGUAGE) + """SELECT count(*) FILTER (WHERE split = 'train') AS train_rows,
  count(*) FILTER (WHERE split = 'test') AS test_rows, count(*) AS all_rows,
  count(*) FILTER (WHERE split = 'train') + count(*) FILTER (WHERE split = 'test') = count(*) AS conserved
FROM language""",
        "profile_table": _with(_LANGUAGE) + """SELECT count(*) AS total_rows, 4 AS total_columns,
  'example_id,symptoms,diagnosis,split' AS columns FROM language""",
        "profile_columns": _with(_VERDICT_LEFT) + "\nUNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count,
  count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM reviewed""" for c in ("symptoms", "diagnosis")
        ),
        "describe_numeric": "\nUNION ALL ".join(_numeric(c) for c in ("n_chars", "doc_id")),
        "most_frequent": "\nUNION ALL ".join(
            f"""(SELECT '{c}' AS column_name, {c}::VARCHAR AS top, count(*) AS freq FROM documents WHERE {c} IS NOT NULL
GROUP BY {c} ORDER BY freq DESC, min(doc_id) LIMIT 1)""" for c in ("lang", "source", "n_chars", "text")
        ),
        "profile_merged": """SELECT 'n_chars' AS column_name, count(*) AS rows, count(n_chars) AS count,
  count(*) - count(n_chars) AS null_count, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std,
  min(n_chars)::DOUBLE AS min, max(n_chars)::DOUBLE AS max, true AS unique_near, true AS quartiles_near FROM documents
""" + "".join(f"""UNION ALL SELECT '{c}', count(*), count({c}), count(*) - count({c}), NULL, NULL, NULL, NULL, true, NULL
FROM documents
""" for c in ("text", "source")),
        "describe_categorical": verdict + "\nUNION ALL ".join(
            _categorical(c) for c in ("symptoms", "diagnosis", "split")
        ),
        "render_prompt": _prompts(),
        "parse_output": verdict + f"""SELECT example_id, raw_output, {_strip("raw_output")} AS predicted,
  NULL::VARCHAR AS reasoning, 'answer_only' AS style
FROM (SELECT example_id, ' ' || CASE diagnosis WHEN 'clean' THEN 'Clean' WHEN 'toxic' THEN 'Toxic'
  WHEN 'low quality' THEN 'Low Quality' ELSE 'Low Quality Toxic' END || ' ' || chr(10) AS raw_output FROM verdict)
UNION ALL SELECT example_id, raw_output, {_strip("json_extract_string(raw_output, '$.diagnosis')")},
  json_extract_string(raw_output, '$.reasoning'), 'reasoned'
FROM (SELECT example_id, to_json({{'diagnosis': ' ' || diagnosis, 'reasoning': split}})::VARCHAR AS raw_output
  FROM verdict)""",
        "flag_invalid_output": _with(_VERDICT, _NUMBERED) + f"""SELECT example_id, predicted, NOT bad AS valid,
  CASE WHEN bad THEN {_feedback("predicted")} END AS feedback
FROM (SELECT *, lower({_strip("predicted")}) NOT IN (SELECT diagnosis FROM verdict) AS bad FROM answers)""",
        **dict.fromkeys(("score_rows", "score_bucketed"), _with(_VERDICT, _NUMBERED) + f"""SELECT v.example_id, v.split, v.diagnosis AS actual, a.predicted,
  coalesce(lower({_strip("a.predicted")}) = v.diagnosis, false)::INT::DOUBLE AS correct
FROM verdict v LEFT JOIN answers a ON a.example_id = v.example_id AND a.split = 'test'"""),
        "majority_rows": _with(_VERDICT, _PARTS, _MAJORITY) + f"SELECT *, {_CORRECT} AS correct FROM majority",
        "nearest_demo_rows": _with(_VERDICT, _PARTS, _WORD_SETS, _NEAREST)
        + f"SELECT *, {_CORRECT} AS correct FROM nearest_demo",
        "words_rows": words + scored,
        "words_rows_by_key": words + scored,
        "accuracy": words + f"SELECT {_BY_SPLIT} FROM ({scored})",
        "accuracy_by_split": words + f"""SELECT split, {_BY_SPLIT},
  count(*) FILTER (WHERE correct = 0) AS disagreements FROM ({scored}) GROUP BY split""",
        "disagreement_count": words
        + f"SELECT split, count(*) FILTER (WHERE correct = 0) AS disagreements FROM ({scored}) GROUP BY split",
        "disagreements": words + """SELECT w.example_id, split, actual, predicted, symptoms
FROM words w JOIN parts p ON p.example_id = w.example_id WHERE actual <> predicted""",
        "prediction_sample": words + """SELECT w.example_id, split, actual, predicted, actual = predicted AS correct,
  symptoms
FROM words w JOIN parts p ON p.example_id = w.example_id
QUALIFY row_number() OVER (PARTITION BY split ORDER BY w.example_id) <= 10""",
        "predict_callable": _with(_LANGUAGE, _cues(0)) + f"SELECT {_CUE_COLUMNS} FROM cues",
        "predict_with_retry": _with(_LANGUAGE, _cues(1)) + f"SELECT {_CUE_COLUMNS} FROM cues",
        "predict_distinct": _with(_LANGUAGE, _cues(0)) + f"SELECT {_CUE_COLUMNS} FROM cues",
        "predict_in_flight": _with(_LANGUAGE, _cues(1)) + f"SELECT {_CUE_COLUMNS} FROM cues",
        "search_proposed": _proposals(),
        "token_usage": _with(_LANGUAGE, _cues(1)) + """SELECT 'cues' AS run_id, split,
  sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens
FROM cues GROUP BY split""",
        "labeled_demos": _with(_VERDICT, _PARTS, _demo_ids("picked", "labeled:42", 4))
        + """SELECT ord::INT AS ord, 'labeled' AS kind, example_id, symptoms, diagnosis
FROM picked JOIN parts USING (example_id)""",
        "bootstrap_demos": _with(
            _VERDICT, _PARTS, _WORD_SETS, _NEAREST,
            _demo_ids("boot", "bootstrap:42", 3, "nearest_demo WHERE split = 'train' AND actual = predicted"),
            _demo_ids(
                "more", "labeled:42", 4,
                "parts WHERE part = 'train' AND example_id NOT IN (SELECT example_id FROM boot)",
            ),
            """picked AS (SELECT ord, 'bootstrapped' AS kind, example_id FROM boot
  UNION ALL SELECT ord + (SELECT count(*) FROM boot), 'labeled', example_id FROM more)""",
        ) + "SELECT ord::INT AS ord, kind, example_id, symptoms, diagnosis FROM picked JOIN parts USING (example_id)",
        "minibatch_sample": _with(_VERDICT, _PARTS, _POOL) + "SELECT round, example_id FROM rounds",
        "candidate_scores": _with(_VERDICT, _PARTS, _WORD_SETS, _CANDIDATES)
        + f"SELECT candidate_id, {_BY_SPLIT} FROM judged GROUP BY candidate_id",
        "best_candidate": _with(_VERDICT, _PARTS, _WORD_SETS, _POOL, _CANDIDATES, _SEARCH)
        + """SELECT candidate_id, at_6 AS minibatch_accuracy, full_accuracy, full_examples
FROM in_full JOIN running USING (candidate_id) ORDER BY full_accuracy DESC, candidate_id LIMIT 1""",
        "prompt_report": _report(),
        "tune_metrics": words + f"""SELECT
  sum(correct) FILTER (WHERE split = 'train') / count(*) FILTER (WHERE split = 'train') AS train_accuracy,
  sum(correct) FILTER (WHERE split = 'validation') / count(*) FILTER (WHERE split = 'validation')
    AS validation_accuracy,
  count(*) FILTER (WHERE split = 'train') AS num_train_examples,
  count(*) FILTER (WHERE split = 'validation') AS num_val_examples
FROM ({scored})""",
        "evaluate_metrics": words + f"""SELECT split, {_BY_SPLIT},
  count(*) FILTER (WHERE correct = 0) AS disagreements, 'evaluate' AS run_id
FROM ({scored}) WHERE split = 'test' GROUP BY split""",
        "run_params_long": _with(_VERDICT, _PARTS, _RUN_TABLE) + _PARAMS,
        "config_json": _with(_VERDICT, _PARTS, _RUN_TABLE) + """SELECT run_id, to_json({'run_id': run_id,
  'requires_training': requires_training, 'lm_model': lm_model, 'train_size': train_size})::VARCHAR AS config_json
FROM run_table""",
        "metrics_long": runs + "SELECT * FROM run_metrics",
        "metrics_latest": """SELECT 'run-' || user_id AS run_id,
  CASE WHEN event_type IN ('click', 'view') THEN 'train' ELSE 'validation' END AS split, event_type AS metric, value
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
        "next_model_version": """SELECT 'model-' || user_id AS name, max(event_id + 1) + 1 AS next_version
FROM events GROUP BY user_id UNION ALL SELECT min('model-' || user_id) || '-new', 1 FROM events""",
        "latest_model_version": """SELECT 'model-' || user_id AS name, max(event_id) + 1 AS version,
  'run-' || max(event_id) AS run_id FROM events GROUP BY user_id""",
        "alias_resolve": """SELECT 'model-' || user_id AS name, event_type AS alias,
  json_extract_string(props, '$.k')::BIGINT AS version
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
        "runs_by_tag": """SELECT 'run-' || event_id AS run_id, '/events/' || event_type || '/user-' || user_id AS experiment
FROM events WHERE event_type = 'purchase' AND value >= 20""",
        "run_provider": """SELECT 'run-' || p_partkey AS run_id,
  CASE WHEN p_type = 'SMALL' THEN p_name ELSE lower(p_type) || '/' || p_name END AS lm_model,
  CASE WHEN p_type <> 'SMALL' THEN lower(p_type) END AS provider, p_name AS model_name FROM part""",
        "compare_runs": runs + "SELECT run_id, " + ", ".join(
            f"max(value) FILTER (WHERE split = '{s}') AS {s}_accuracy" for s in ("train", "validation", "test")
        ) + " FROM run_metrics WHERE metric = 'accuracy' GROUP BY run_id",
        "metric_diff": runs + """SELECT a.split, a.metric, a.value AS first_value, b.value AS second_value,
  b.value - a.value AS difference
FROM run_metrics a JOIN run_metrics b USING (split, metric) WHERE a.run_id = 'majority' AND b.run_id = 'words'""",
        "winner": runs + """SELECT difference, CASE WHEN difference > 0.01 THEN 'words'
  WHEN difference < -0.01 THEN 'nearest_demo' ELSE 'tie' END AS winner
FROM (SELECT b.value - a.value AS difference FROM run_metrics a JOIN run_metrics b USING (split, metric)
  WHERE a.run_id = 'nearest_demo' AND b.run_id = 'words' AND split = 'validation' AND metric = 'accuracy')""",
        "evaluate_best": runs + f"""SELECT {_BY_SPLIT}, run_id FROM (
  SELECT run_id, correct FROM scored WHERE split = 'test' AND run_id = (SELECT run_id FROM run_metrics
    WHERE split = 'validation' AND metric = 'accuracy' ORDER BY value DESC, run_id LIMIT 1)
  ORDER BY example_id LIMIT 10) GROUP BY run_id""",
        "best_run": runs + """SELECT run_id, value FROM run_metrics
WHERE split = 'validation' AND metric = 'accuracy' ORDER BY value DESC, run_id LIMIT 1""",
        **_tracked(runs),
        **_unusual(),
    }


def _tracked(runs: str) -> dict[str, str]:
    """What a tuned and evaluated run of the most frequent label leaves in the tables."""
    value = "SELECT value FROM run_metrics WHERE run_id = 'majority' AND split = '{}' AND metric = 'accuracy'"
    size = "SELECT count(*)::VARCHAR FROM parts WHERE part = '{}'"
    params = {
        "framework": "'majority'",
        "requires_training": "'True'",
        "train_size": f"({size.format('train')})",
        "val_size": f"({size.format('validation')})",
        "dataset_train_source": "'documents+labels'",
        "dataset_train_size": f"({size.format('train')})",
        "dataset_validation_source": "'documents+labels'",
        "dataset_validation_size": f"({size.format('validation')})",
        "model_name": "'m'",
        "model_version": "'best'",
        "split": "'test'",
        "eval_size": f"({size.format('test')})",
        "dataset_test_source": "'documents+labels'",
        "dataset_test_size": f"({size.format('test')})",
    }
    cues = _with(_LANGUAGE, _cues(1))
    return {
        "store_params": _with(_VERDICT, _PARTS)
        + "\nUNION ALL ".join(f"SELECT 'majority' AS run_id, '{k}' AS key, {v} AS value" for k, v in params.items()),
        "store_metrics": runs + "SELECT * FROM run_metrics WHERE run_id = 'majority'",
        "store_versions": runs + f"""SELECT 'm' AS name, 1::BIGINT AS version, 'majority' AS run_id,
  ({value.format("train")}) AS train_accuracy, ({value.format("validation")}) AS validation_accuracy,
  'majority' AS predictor, 1::BIGINT AS alias_version""",
        "compare_logged_runs": runs + f"""SELECT 'majority' AS run_id, ({value.format("train")}) AS train_accuracy,
  ({value.format("validation")}) AS validation_accuracy, ({value.format("test")}) AS test_accuracy,
  'majority' AS framework""",
        "best_logged_run": runs + f"""SELECT 'majority' AS run_id, ({value.format("validation")}) AS value""",
        "run_tokens": cues + """SELECT split, 'prompt_tokens' AS metric, sum(prompt_tokens)::DOUBLE AS value
FROM cues WHERE split <> 'test' GROUP BY split
UNION ALL SELECT split, 'completion_tokens', sum(completion_tokens)::DOUBLE FROM cues WHERE split <> 'test' GROUP BY split
UNION ALL SELECT split, 'errors', 0.0 FROM cues WHERE split <> 'test' GROUP BY split""",
    }


def _unusual() -> dict[str, str]:
    keys = """WITH keys AS (SELECT CASE WHEN l_orderkey % 7 <> 0 THEN l_orderkey || '-' || l_linenumber END AS example_id
  FROM lineitem)
"""
    by_length = _with(_VERDICT, _PARTS, """answered AS (SELECT example_id, part AS split, diagnosis AS actual,
  CASE WHEN length(symptoms) < 500 THEN 'low quality' ELSE 'clean' END AS predicted FROM parts)""")
    cues = _with(_LANGUAGE, _cues(0))
    sizes = "\nUNION ALL ".join(
        f"SELECT '{name}' AS name, {known} AS known, count(*) AS num_rows FROM language WHERE {where}"
        for name, known, where in (
            ("train", "true", f"split = 'train' AND md5('42:' || example_id) < '{_SHARE}'"),
            ("validation", "true", f"split = 'train' AND md5('42:' || example_id) >= '{_SHARE}'"),
            ("test", "true", "split = 'test'"),
            ("all", "true", "true"),
            ("train_full", "true", "split = 'train'"),
            ("holdout", "false", "false"),
        )
    )
    return {
        "repeated_ids": """SELECT count(*) FILTER (WHERE user_id % 5 = 0) AS null_ids,
  count(*) FILTER (WHERE user_id % 5 <> 0) - count(DISTINCT user_id) FILTER (WHERE user_id % 5 <> 0) AS repeated_ids
FROM events""",
        "first_n_large": keys + "SELECT * FROM keys WHERE example_id IS NOT NULL ORDER BY example_id LIMIT 10001",
        "sample_large": keys + """SELECT * FROM keys WHERE example_id IS NOT NULL
ORDER BY md5('large:' || example_id) LIMIT 12000""",
        "parts_with_other_split": _with(_VERDICT, _PARTS) + """SELECT example_id, part AS split FROM parts
WHERE example_id % 7 NOT IN (0, 1)""",
        "population_sizes": _with(_LANGUAGE) + sizes,
        "with_roles": _with(_LANGUAGE) + "SELECT example_id, symptoms AS input_text, diagnosis AS label FROM language",
        "registered_predictor": by_length + f"SELECT *, {_CORRECT} AS correct FROM answered",
        "own_metric": by_length + """SELECT split, sum(CASE WHEN actual = predicted THEN 1.0
  WHEN split_part(actual, ' ', 1) = split_part(predicted, ' ', 1) THEN 0.5 ELSE 0.0 END)::DOUBLE AS points
FROM answered GROUP BY split""",
        "own_validator": _with(_VERDICT, _NUMBERED)
        + "SELECT example_id, NOT starts_with(predicted, '1. ') AS valid FROM answers",
        # The model answers EN to any feedback.
        "predict_with_validator": cues + """SELECT example_id,
  CASE WHEN first_answer = 'fr' THEN 'fr' ELSE 'EN' END AS predicted,
  CASE WHEN first_answer = 'fr' THEN 1 ELSE 2 END AS attempts, true AS valid FROM answered""",
        "predict_with_errors": cues + f"""SELECT example_id, CASE WHEN NOT bad THEN first_answer END AS predicted,
  NOT bad AND first_answer <> 'unknown' AS valid, 1 AS attempts,
  CASE WHEN bad THEN 'ConnectionError: no answer' END AS error,
  CASE WHEN bad THEN 0.0 ELSE (first_answer = actual)::INT::DOUBLE END AS correct
FROM (SELECT *, contains(message, ' der ') AS bad FROM answered)""",
        "predict_resumed": cues + """SELECT example_id, first_answer AS predicted, first_answer <> 'unknown' AS valid,
  NULL::VARCHAR AS error FROM answered""",
    }
