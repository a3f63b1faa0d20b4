"""Prompts, generation, output cleaning, verdicts and evaluation."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import (ANSWER_BOUNDARY, CONTEXT_SEPARATOR, NO_CONTEXT_TEMPLATE, PROMPT_HEAD,
                                   PROMPT_QUESTION, PROMPT_TAIL, REASONING_STARTERS, judge_prompt, parse_verdict,
                                   strip_reasoning)
from quarry.operators.answers import answer, generate, prompts
from quarry.operators.contain import containing
from quarry.operators.evaluate import evaluate, hit_flags, totals, write_results
from quarry.operators.retrieve import keep_min_score
from quarry.plans import callables
from quarry.plans import sql as S
from quarry.plans.corpus_checks import DOC_CHUNKS_SQL
from quarry.plans.registry import register, table
from quarry.plans.search_checks import KNN_K, TEXT_HITS_SQL, dense_knn, passages, text_hits
from quarry.session import materialize, scratch_path
from quarry.sources.tables import read_question_set

L = S.sql_str


def benchmark_questions(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))


def prompt_sql(q: str, ctx: str) -> str:
    return (f"CASE WHEN {ctx} IS NULL THEN {L(NO_CONTEXT_TEMPLATE[0])} || {q} || {L(NO_CONTEXT_TEMPLATE[1])} "
            f"ELSE {L(PROMPT_HEAD)} || {ctx} || {L(PROMPT_QUESTION)} || {q} || {L(PROMPT_TAIL)} END")


HITS_META_SQL = f"""(
  SELECT h.query_id, h.rank, h.hit_id, h.score, c.section_id, coalesce(d.source, '') AS title, c.text
  FROM {TEXT_HITS_SQL} h JOIN {DOC_CHUNKS_SQL} c ON c.chunk_id = h.hit_id JOIN documents d ON d.doc_id = c.doc_id
)"""


@register("prompt_context", f"""
WITH ctx AS (SELECT query_id, string_agg('[' || section_id || ' | ' || title || ']' || chr(10) || text,
                                         {L(CONTEXT_SEPARATOR)} ORDER BY rank) AS context
             FROM {HITS_META_SQL} GROUP BY query_id)
SELECT b.item_id, {prompt_sql('b.text', 'ctx.context')} AS prompt
FROM benchmark b LEFT JOIN ctx ON ctx.query_id = b.item_id
""")
def prompt_context(spark, sf):
    hits = text_hits(spark, sf, attach=["section_id", "title", "text"])
    return prompts(benchmark_questions(spark, sf), hits, "item_id", "question").select("item_id", "prompt")


# Made-up model outputs around each turn, chosen by turn % 5.
PREAMBLE_2 = "Okay, let me read the context and check which passage applies here."
PREAMBLE_3 = "Let me see."
PREAMBLE_4 = "The user asks about this; I will reply directly."


def wrapped_turns(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    t = F.coalesce(F.col("text"), F.lit(""))
    raw = (F.when(F.col("turn") % 5 == 1, F.concat(F.lit("<think>"), F.col("role"), F.lit(" notes</think>\n"), t))
           .when(F.col("turn") % 5 == 2, F.concat(F.lit(PREAMBLE_2 + "\n\nAnswer: "), t))
           .when(F.col("turn") % 5 == 3, F.concat(F.lit(PREAMBLE_3 + "\n\nAccording to the context, "), t))
           .when(F.col("turn") % 5 == 4, F.concat(F.lit(PREAMBLE_4 + "\n"), t))
           .otherwise(t))
    return c.select("conv_id", "turn", raw.alias("raw"))


_BOUNDARY_SQL = L(ANSWER_BOUNDARY)
def _strip_reasoning_sql(t: str) -> str:
    head = f"lower(substring({t}, 1, 200))"
    starter = " OR ".join(f"contains({head}, {L(s)})" for s in REASONING_STARTERS)
    before = f"regexp_extract({t}, '(?is)^(.*?)' || {_BOUNDARY_SQL}, 1)"
    return f"""CASE
      WHEN contains(lower({t}), '</think>') THEN {S.strip(f"regexp_replace({t}, '(?is)^.*</think>', '')")}
      WHEN ({starter}) AND regexp_matches({t}, '(?i)' || {_BOUNDARY_SQL}) AND length({before}) > 50
        THEN {S.strip(f"substring({t}, length({before}) + 1)")}
      ELSE {t} END"""


@register("strip_reasoning", f"""
WITH w AS (
  SELECT conv_id, turn, CASE turn % 5
      WHEN 1 THEN '<think>' || role || ' notes</think>' || chr(10) || coalesce(text, '')
      WHEN 2 THEN {L(PREAMBLE_2 + chr(10) * 2 + "Answer: ")} || coalesce(text, '')
      WHEN 3 THEN {L(PREAMBLE_3 + chr(10) * 2 + "According to the context, ")} || coalesce(text, '')
      WHEN 4 THEN {L(PREAMBLE_4 + chr(10))} || coalesce(text, '')
      ELSE coalesce(text, '') END AS raw
  FROM conversations),
s AS (SELECT conv_id, turn, {S.strip('raw')} AS t FROM w)
SELECT conv_id, turn, {_strip_reasoning_sql('t')} AS text FROM s
""")
def strip_reasoning_check(spark, sf):
    return wrapped_turns(spark, sf).select("conv_id", "turn", strip_reasoning("raw").alias("text"))


@register("judge_prompt", """
SELECT conv_id, turn,
       'Question: ' || coalesce(text, '') || chr(10) || 'Expected BNS section: BNS_' || CAST(conv_id AS VARCHAR)
       || chr(10) || 'Candidate answer:' || chr(10)
       || coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || chr(10) AS prompt
FROM conversations
""")
def judge_prompt_check(spark, sf):
    c = table(spark, sf, "conversations")
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", judge_prompt(
        F.coalesce("text", F.lit("")), F.concat(F.lit("BNS_"), F.col("conv_id").cast("string")),
        F.coalesce(nxt, F.lit(""))).alias("prompt"))


def _verdict_text():
    p = F.col("props")
    v = F.col("event_id") % 7
    return (F.when(v == 0, F.expr("substring(props, 1, length(props) - 1)"))
            .when(v == 1, F.concat(F.lit("```json\n"), F.regexp_replace(p, '"k"', '"correctness"'), F.lit("\n```")))
            .when(v == 2, F.concat(F.lit("```\n"), p, F.lit("\n```")))
            .when(v == 3, F.regexp_replace(p, r'"k": ([0-9]+)', '"correctness": $1.5, "citation": 1, "reason": "ok"'))
            .when(v == 4, F.regexp_replace(p, '"k"', '"citation"'))
            .when(v == 5, F.concat(F.lit("["), p, F.lit("]")))
            .otherwise(p))


def _fence_sql(x: str) -> str:
    return S.strip(f"regexp_replace(regexp_replace({S.strip(x)}, '^```json', ''), '```$', '')")


@register("judge_parse", f"""
WITH r AS (
  SELECT event_id, CASE event_id % 7
      WHEN 0 THEN substring(props, 1, length(props) - 1)
      WHEN 1 THEN '```json' || chr(10) || regexp_replace(props, '"k"', '"correctness"') || chr(10) || '```'
      WHEN 2 THEN '```' || chr(10) || props || chr(10) || '```'
      WHEN 3 THEN regexp_replace(props, '"k": ([0-9]+)', '"correctness": \\1.5, "citation": 1, "reason": "ok"')
      WHEN 4 THEN regexp_replace(props, '"k"', '"citation"')
      WHEN 5 THEN '[' || props || ']'
      ELSE props END AS raw
  FROM events),
p AS (SELECT event_id, try_cast({_fence_sql('raw')} AS JSON) AS v FROM r)
SELECT event_id,
  CASE WHEN v IS NULL THEN 0 ELSE coalesce(CAST(trunc(try_cast(json_extract_string(v, '$.correctness') AS DOUBLE)) AS BIGINT), 0) END AS correctness,
  CASE WHEN v IS NULL THEN 0 ELSE coalesce(CAST(trunc(try_cast(json_extract_string(v, '$.citation') AS DOUBLE)) AS BIGINT), 0) END AS citation,
  CASE WHEN v IS NULL THEN 'judge parse failure' ELSE json_extract_string(v, '$.reason') END AS reason
FROM p
""")
def judge_parse(spark, sf):
    e = table(spark, sf, "events").select("event_id", "props")
    v = parse_verdict(_verdict_text())
    return e.select("event_id", v.alias("j")).select(
        "event_id", F.col("j.correctness").cast("long").alias("correctness"),
        F.col("j.citation").cast("long").alias("citation"), F.col("j.reason").alias("reason"))


EVAL_MIN = 0.55


@register("eval_metrics", f"""
WITH r AS (SELECT * FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS hit_id, c.label AS hit_label,
         round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id) AS rk
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id
  QUALIFY rk <= {KNN_K}) WHERE score >= {EVAL_MIN} OR rk = 1),
f AS (SELECT q.vec_id,
        coalesce(bool_or(r.hit_label = q.label), false) AS in5,
        coalesce(bool_or(r.rk = 1 AND r.hit_label = q.label), false) AS in1
      FROM embeddings q LEFT JOIN r ON r.query_id = q.vec_id GROUP BY q.vec_id)
SELECT avg(CAST(in5 AS INTEGER)) AS hit_at_5, avg(CAST(in1 AS INTEGER)) AS hit_at_1,
       sum(CASE WHEN in1 THEN 5 WHEN in5 THEN 3 ELSE 0 END) / (5.0 * count(*)) AS judge_correctness_avg,
       sum(CASE WHEN in1 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS judge_citation_avg,
       count(*) AS n_examples
FROM f
""")
def eval_metrics(spark, sf):
    e = table(spark, sf, "embeddings")
    hits = keep_min_score(dense_knn(spark, sf), KNN_K, EVAL_MIN)
    labels = e.select(F.col("vec_id").alias("hit_id"), F.col("label").alias("section_id"))
    hits = hits.join(labels, "hit_id")
    items = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("expected_section"))
    rows = hit_flags(items, hits, "query_id", "expected_section", "section_id", KNN_K)
    verdict = F.concat(F.lit('{"correctness": '),
                       F.when(F.col("in_top_1"), 5).when(F.col("in_top_5"), 3).otherwise(0).cast("string"),
                       F.lit(', "citation": '), F.col("in_top_1").cast("int").cast("string"), F.lit("}"))
    rows = rows.withColumn("judge", parse_verdict(verdict))
    return totals(rows, KNN_K)


@register("passage_eval", f"""
WITH exp AS (SELECT b.item_id, list(DISTINCT CAST(d.doc_id AS VARCHAR)) AS expected
             FROM benchmark b JOIN documents d ON length(b.text) > 0 AND contains(d.text, b.text)
             GROUP BY b.item_id),
h AS (SELECT query_id, rank, section_id FROM {HITS_META_SQL}),
f AS (SELECT b.item_id, coalesce(bool_or(list_contains(e.expected, h.section_id)), false) AS in5,
             coalesce(bool_or(h.rank = 1 AND list_contains(e.expected, h.section_id)), false) AS in1
      FROM benchmark b LEFT JOIN exp e ON e.item_id = b.item_id LEFT JOIN h ON h.query_id = b.item_id
      GROUP BY b.item_id)
SELECT avg(CAST(in5 AS INTEGER)) AS hit_at_5, avg(CAST(in1 AS INTEGER)) AS hit_at_1,
       sum(CASE WHEN in1 THEN 5 ELSE 1 END) / (5.0 * count(*)) AS judge_correctness_avg,
       sum(CASE WHEN in1 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS judge_citation_avg,
       count(*) AS n_examples
FROM f
""")
def passage_eval(spark, sf):
    """Every document that holds a question's text counts as right; a
    question that no document holds counts as a miss."""
    q = benchmark_questions(spark, sf)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    right = materialize(containing(q, docs, "item_id", "question", "doc_id", "text")
                        .select("item_id", F.col("doc_id").alias("expected_id")))
    base = scratch_path(spark, "evaluation")
    evaluate(q, passages(spark, sf), callables.cite_first_block, callables.rule_judge_any, base,
             question_id="item_id", passage_id="chunk_id", expected=right)
    m = spark.read.json(f"{base}/metrics")
    return m.select("hit_at_5", "hit_at_1", "judge_correctness_avg", "judge_citation_avg", "n_examples")


QUESTIONS_A_FILE = 50  # items of one nested question-set document


@register("question_set", f"""
SELECT CAST(item_id AS BIGINT) AS item_id, text AS question, item_id % 2 = 0 AS in_top_1
FROM benchmark
""")
def question_set(spark, sf):
    """A nested JSON question set, in documents of a bounded number of items,
    written, read, flagged, and its result rows written and read back."""
    base = scratch_path(spark, "questions")
    b = table(spark, sf, "benchmark")
    items = F.sort_array(F.collect_list(F.struct("item_id", F.col("text").alias("question"),
                                                 F.lit("A").alias("expected_section"))))
    parts = max(1, -(-b.count() // QUESTIONS_A_FILE))
    (b.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("part")).agg(items.alias("items"))
     .select(F.lit("1.0").alias("version"), "items").write.option("maxRecordsPerFile", 1).json(f"{base}/set"))
    read = read_question_set(spark, f"{base}/set")
    hits = read.select(F.col("item_id").alias("query_id"), F.lit(1).alias("rank"),
                       F.when(F.col("item_id") % 2 == 0, "A").otherwise("B").alias("section_id"))
    rows = hit_flags(read, hits, "item_id")
    write_results(rows, totals(rows), f"{base}/out")
    return spark.read.json(f"{base}/out/results").select("item_id", "question", "in_top_1")


@register("generate", f"""
SELECT item_id, {S.strip("coalesce(text, '')")} AS answer, length({S.strip("coalesce(text, '')")}) AS answer_chars
FROM benchmark
""")
def generate_check(spark, sf):
    q = benchmark_questions(spark, sf)
    g = generate(q, callables.think_then_echo, "question", system_prompt="You answer from the context.")
    return g.select("item_id", "answer", F.length("answer").cast("long").alias("answer_chars"))


@register("answer_bundle", f"""
WITH c AS (SELECT query_id, count(*) AS n_citations, string_agg(hit_id, ',' ORDER BY rank) AS citation_ids,
                  arg_min('According to [' || section_id || ' | ' || title || ']', rank) AS answer
           FROM {HITS_META_SQL} GROUP BY query_id),
cat AS (SELECT p_partkey, coalesce(p_name, '') || '. ' || coalesce(p_type, '') || '. Eligibility: '
               || coalesce(p_brand, '') AS t FROM part),
qb AS (SELECT item_id, text FROM benchmark WHERE {S.strip("coalesce(text, '')")} <> ''),
m AS (SELECT item_id, count(*) AS n_schemes, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY rk) AS scheme_ids
      FROM {S.sparse_top_k(S.hashed_long('qb', 'item_id', 'text'), S.hashed_long('cat', 'p_partkey', 't'),
                            'item_id', 'p_partkey', 3)}
      WHERE score >= 0.25 GROUP BY item_id)
SELECT b.item_id, coalesce(c.answer, 'No context.') AS answer,
       CAST(coalesce(c.n_citations, 0) AS INTEGER) AS n_citations, CAST(coalesce(m.n_schemes, 0) AS INTEGER) AS n_schemes,
       coalesce(c.citation_ids, '') AS citation_ids, coalesce(m.scheme_ids, '') AS scheme_ids
FROM benchmark b LEFT JOIN c ON c.query_id = b.item_id LEFT JOIN m ON m.item_id = b.item_id
""")
def answer_bundle(spark, sf):
    q = benchmark_questions(spark, sf)
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand").fillna("")
    a = answer(q, passages(spark, sf), callables.cite_first_block, catalogue=part,
               catalogue_kw=dict(catalogue_id="p_partkey", name="p_name", description="p_type",
                                 eligibility="p_brand"),
               question_id="item_id", question_text="question", passage_id="chunk_id")
    return a.select(
        "item_id", "answer", F.size("citations").alias("n_citations"), F.size("schemes").alias("n_schemes"),
        F.array_join(F.transform("citations", lambda c: c["chunk_id"]), ",").alias("citation_ids"),
        F.array_join(F.transform("schemes", lambda s: s["id"]), ",").alias("scheme_ids"))
