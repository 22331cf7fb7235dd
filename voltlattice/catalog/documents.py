"""Chunking, exact retrieval, grounding and prompts."""

from pyspark.sql import functions as F

from voltlattice.catalog.registry import d, query, rnd
from voltlattice.functions import text as tx
from voltlattice.functions.rounding import pround
from voltlattice.operators import chunking, similarity
from voltlattice.plans import knowledge
from voltlattice.sources import fixtures as fx

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(value: str) -> str:
    return f"regexp_replace({value}, '\\A{_SPACE}+|{_SPACE}+\\z', '', 'g')"


def slug(value: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({value}), '[^a-zA-Z0-9]', '_', 'g'), '_+', '_', 'g'), '_')"


def _windows(value: str) -> str:
    return (f"list_transform(range(0, length({value}), 400), lambda s: substr({value}, CAST(s + 1 AS BIGINT), 500))")


CHUNKS = f"""
    parts AS (SELECT source, type, unnest(CASE WHEN type = 'markdown_doc'
        THEN string_split(regexp_replace(content, '\\n(#{{1,3}}\\s)', chr(1) || '\\1', 'g'), chr(1)) ELSE [content] END) AS body,
        generate_subscripts(CASE WHEN type = 'markdown_doc'
        THEN string_split(regexp_replace(content, '\\n(#{{1,3}}\\s)', chr(1) || '\\1', 'g'), chr(1)) ELSE [content] END, 1) AS section FROM docs),
    trimmed AS (SELECT source, type, section, CASE WHEN type = 'markdown_doc' THEN {strip("body")} ELSE body END AS body FROM parts),
    cut AS (SELECT *, CASE WHEN type = 'markdown_doc' AND length(body) <= 500 THEN [body] ELSE {_windows("body")} END AS pieces FROM trimmed),
    flat AS (SELECT source, type, section, body, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM cut),
    chunks AS (SELECT source, type, CASE WHEN type <> 'markdown_doc' THEN NULL WHEN starts_with(body, '#')
          THEN {strip("regexp_replace(string_split(body, chr(10))[1], '^#+', '')")} ELSE 'General' END AS title,
        {strip("piece")} AS text, row_number() OVER (PARTITION BY source ORDER BY section, i) AS n
      FROM flat WHERE {strip("piece")} <> ''),
    numbered AS (SELECT {slug("source")} || '_chunk_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS chunk_id,
        source, coalesce(title, 'Artifact Data Part ' || n) AS section_title, text, type, n FROM chunks)"""


def chunks(spark, sf_dir):
    return chunking.chunk_documents(fx.documents(spark, sf_dir))


@query("fn_9_slugify", f"SELECT source, {slug('source')} AS slug FROM docs")
def slugify(spark, sf_dir):
    return fx.documents(spark, sf_dir).select("source", tx.slugify(F.col("source")).alias("slug"))


@query("fn_10_heading_split", f"""
    SELECT source, section_title, count(*) AS n_chunks FROM (WITH {CHUNKS} SELECT * FROM numbered) WHERE type = 'markdown_doc' GROUP BY ALL""")
def heading_split(spark, sf_dir):
    return chunks(spark, sf_dir).filter("type = 'markdown_doc'").groupBy("source", "section_title").agg(
        F.count(F.lit(1)).alias("n_chunks")
    )


@query("fn_11_overlapping_windows", f"""
    WITH {CHUNKS} SELECT chunk_id, length(text) AS n_chars, md5(text) AS digest FROM numbered WHERE type = 'markdown_doc'""")
def overlapping_windows(spark, sf_dir):
    return chunks(spark, sf_dir).filter("type = 'markdown_doc'").select(
        "chunk_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest")
    )


@query("fn_12_fixed_windows", f"""
    WITH {CHUNKS} SELECT chunk_id, section_title, md5(text) AS digest FROM numbered WHERE type <> 'markdown_doc'""")
def fixed_windows(spark, sf_dir):
    return chunks(spark, sf_dir).filter("type <> 'markdown_doc'").select("chunk_id", "section_title", F.md5("text").alias("digest"))


@query("fn_13_chunk_ids", f"""
    WITH {CHUNKS} SELECT source, count(*) AS n_chunks, min(chunk_id) AS first_id, max(n) AS last_number FROM numbered GROUP BY source""")
def chunk_ids(spark, sf_dir):
    number = F.regexp_extract("chunk_id", r"(\d+)\z", 1).cast("long")
    return chunks(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("first_id"), F.max(number).alias("last_number")
    )


@query("job_10_chunk_documents", f"WITH {CHUNKS} SELECT chunk_id, source, section_title, text, type FROM numbered")
def chunk_documents(spark, sf_dir):
    return chunks(spark, sf_dir)


@query("fn_14_l2_normalize", f"""
    WITH scaled AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (vec_id % 3)) AS v FROM embeddings),
      normed AS (SELECT vec_id, sqrt(list_inner_product(v, v)) AS norm, v FROM scaled)
    SELECT vec_id, {rnd("v[1] / CASE WHEN norm = 0 THEN 1e-12 ELSE norm END", 8)} AS first_value, {rnd("v[64] / CASE WHEN norm = 0 THEN 1e-12 ELSE norm END", 8)} AS last_value,
      {rnd("sqrt(list_inner_product(v, v)) / CASE WHEN norm = 0 THEN 1e-12 ELSE norm END", 6)} AS new_norm FROM normed""")
def l2_normalize(spark, sf_dir):
    """Vectors scaled by 0, 1 or 2 come back with norm 0 or 1."""
    factor = (F.col("vec_id") % 3).cast("double")
    scaled = F.transform("embedding", lambda x: x.cast("double") * factor)
    unit = fx.table(spark, sf_dir, "embeddings").select("vec_id", tx.l2_normalize(scaled).alias("u"))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    return unit.select(
        "vec_id", pround(F.get("u", F.lit(0)), 8).alias("first_value"), pround(F.get("u", F.lit(63)), 8).alias("last_value"),
        pround(norm, 6).alias("new_norm"),
    )


@query("jn_10_similarity_join", f"""
    SELECT query_id, chunk_id, {rnd("s", 4)} AS score FROM (SELECT query_id, chunk_id,
        list_inner_product(q.embedding, v.embedding) AS s, row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(q.embedding, v.embedding) DESC, chunk_id) AS r
      FROM questions q, vectors v) WHERE r <= 1""")
def similarity_join(spark, sf_dir):
    """Nearest vector of every query through the blocked path that scales with both sides."""
    return similarity.search(
        fx.questions(spark, sf_dir), fx.vectors(spark, sf_dir), 1, slice_values=16_000, block_rows=64
    ).select("query_id", "chunk_id", "score")


@query("top_4_cosine_top_k", f"""
    SELECT query_id, chunk_id, {rnd("s", 4)} AS score, CAST(r AS INTEGER) AS rank FROM (SELECT query_id, chunk_id,
        list_inner_product(q.embedding, v.embedding) AS s, row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(q.embedding, v.embedding) DESC, chunk_id) AS r
      FROM questions q, vectors v) WHERE r <= 3""")
def cosine_top_k(spark, sf_dir):
    return similarity.search(fx.questions(spark, sf_dir), fx.vectors(spark, sf_dir), 3)


@query("top_5_threshold", f"SELECT query_id, chunk_id, score, rank FROM ranked WHERE score >= {d(0.4)}")
def threshold(spark, sf_dir):
    return similarity.retrieve(fx.questions(spark, sf_dir), fx.vectors(spark, sf_dir))


@query("agg_22_max_score", f"""
    SELECT q.query_id, coalesce(max(score), 0) AS max_score FROM questions q LEFT JOIN (SELECT * FROM ranked WHERE score >= {d(0.4)}) r USING (query_id) GROUP BY q.query_id""")
def max_score(spark, sf_dir):
    questions = fx.questions(spark, sf_dir)
    found = similarity.retrieve(questions, fx.vectors(spark, sf_dir))
    return questions.select("query_id").join(knowledge.max_score(found), "query_id", "left").na.fill(0.0)


STRICT = 0.45


@query("fn_15_grounding", f"""
    SELECT q.query_id, max(score) IS NOT NULL AS grounded, coalesce(max(score), 0) AS confidence_score,
      CASE WHEN max(score) IS NULL THEN '{knowledge.REFUSAL}' END AS answer, max(score) IS NOT NULL AS needs_generation
    FROM questions q LEFT JOIN (SELECT * FROM ranked WHERE score >= {d(STRICT)} AND rank > 1) r USING (query_id) GROUP BY q.query_id""")
def grounding(spark, sf_dir):
    """Outcomes when the question's own vector does not count as a source."""
    questions = fx.questions(spark, sf_dir)
    found = similarity.retrieve(questions, fx.vectors(spark, sf_dir), 3, STRICT).filter("rank > 1")
    return knowledge.ground(questions, found).drop("question")


@query("fn_15_grounding_offline", f"""
    SELECT q.query_id, max(score) IS NOT NULL AS grounded,
      CASE WHEN max(score) IS NULL THEN 'refused' ELSE 'unavailable' END AS outcome, FALSE AS needs_generation
    FROM questions q LEFT JOIN ranked r USING (query_id) GROUP BY q.query_id""")
def grounding_offline(spark, sf_dir):
    questions = fx.questions(spark, sf_dir)
    found = similarity.retrieve(questions, fx.vectors(spark, sf_dir), 3, -1.0)
    outcome = F.when(F.col("answer") == knowledge.REFUSAL, "refused").when(F.col("answer") == knowledge.UNAVAILABLE, "unavailable")
    return knowledge.ground(questions, found, provider_available=False).select(
        "query_id", "grounded", outcome.alias("outcome"), "needs_generation"
    )


def vector_chunks(spark, sf_dir):
    """Chunk text behind each vector."""
    label = F.col("label").cast("string")
    return fx.vectors(spark, sf_dir).select(
        "chunk_id", F.concat(F.lit("notes/"), label, F.lit(".md")).alias("source"),
        F.concat(F.lit("Section "), label).alias("section_title"), F.concat(F.lit("Text of "), F.col("chunk_id")).alias("text"),
    )


PROMPTS = f"""
    used AS (SELECT r.query_id, r.rank, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS i, v.chunk_id, v.label
      FROM ranked r JOIN vectors v USING (chunk_id) WHERE score >= {d(0.4)}),
    blocks AS (SELECT query_id, string_agg('<snippet id="' || i || '" source="notes/' || label || '.md" section="Section ' || label || '">' || chr(10)
        || 'Text of ' || chunk_id || chr(10) || '</snippet>', chr(10) || chr(10) ORDER BY i) AS evidence FROM used GROUP BY query_id),
    prompts AS (SELECT query_id, '<evidence>' || chr(10) || evidence || chr(10) || '</evidence>' || chr(10) || chr(10) || 'QUESTION: ' || question
        || chr(10) || chr(10) || '{knowledge.PROMPT_END}' AS prompt FROM blocks JOIN questions USING (query_id))"""


@query("fn_16_prompts", f"WITH {PROMPTS} SELECT query_id, prompt FROM prompts")
def prompts(spark, sf_dir):
    questions = fx.questions(spark, sf_dir)
    found = similarity.retrieve(questions, fx.vectors(spark, sf_dir))
    return knowledge.build_prompts(questions, knowledge.sources(found, vector_chunks(spark, sf_dir)))


@query("job_11_retrieve_and_ground", f"""
    WITH {PROMPTS}, best AS (SELECT query_id, max(score) AS s FROM ranked WHERE score >= {d(0.4)} GROUP BY query_id)
    SELECT q.query_id, q.question, s IS NOT NULL AS grounded, coalesce(s, 0) AS confidence_score,
      CASE WHEN s IS NULL THEN '{knowledge.REFUSAL}' END AS answer, s IS NOT NULL AS needs_generation, prompt
    FROM questions q LEFT JOIN best USING (query_id) LEFT JOIN prompts p USING (query_id)""")
def retrieve_and_ground(spark, sf_dir):
    return knowledge.retrieve_and_ground(fx.questions(spark, sf_dir), fx.vectors(spark, sf_dir), vector_chunks(spark, sf_dir))


def prior(spark, sf_dir):
    """Prior scores of the questions with an odd vector number; the others have none."""
    v = F.col("vec_id")
    return fx.table(spark, sf_dir, "embeddings").filter(v % 2 == 1).select(
        F.concat(F.lit("Q"), F.lpad(v.cast("string"), 8, "0")).alias("query_id"), (v % 50 / 100).alias("old_score")
    )


EVALUATED = f"""
    best AS (SELECT query_id, score FROM ranked WHERE rank = 1 AND score >= 0),
    scored AS (SELECT q.query_id, q.category, coalesce(score, 0) AS score FROM questions q LEFT JOIN best USING (query_id)),
    old AS (SELECT 'Q' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS query_id, (vec_id % 50) / 100 AS old_score FROM embeddings WHERE vec_id % 2 = 1),
    compared AS (SELECT s.*, coalesce(old_score, 0) AS old_score FROM scored s LEFT JOIN old USING (query_id))"""
_SUMMARY = f"""count(*) AS n_queries, {rnd("avg(old_score)", 8)} AS old_avg, {rnd("avg(score)", 8)} AS new_avg, min(score) AS new_min,
      max(score) AS new_max, {rnd("avg(score - old_score)", 8)} AS delta_avg"""


def _summary(df):
    return df.withColumns({c: pround(c, 8) for c in ("old_avg", "new_avg", "delta_avg")})


@query("job_12_evaluate_retrieval", f"WITH {EVALUATED} SELECT category, {_SUMMARY} FROM compared GROUP BY category")
def evaluate_retrieval(spark, sf_dir):
    return _summary(knowledge.evaluate_retrieval(fx.questions(spark, sf_dir), fx.vectors(spark, sf_dir), prior(spark, sf_dir)))


@query("agg_20_score_summary", f"""
    WITH scored AS (SELECT query_id, avg(score) AS score FROM ranked GROUP BY query_id),
      old AS (SELECT 'Q' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS query_id, (vec_id % 50) / 100 AS old_score FROM embeddings WHERE vec_id % 2 = 1),
      compared AS (SELECT q.category, score, coalesce(old_score, 0) AS old_score FROM scored JOIN questions q USING (query_id) LEFT JOIN old USING (query_id))
    SELECT category, count(*) AS n_queries, {rnd("avg(old_score)", 8)} AS old_avg, {rnd("avg(score)", 8)} AS new_avg, {rnd("min(score)", 8)} AS new_min,
      {rnd("max(score)", 8)} AS new_max, {rnd("avg(score - old_score)", 8)} AS delta_avg FROM compared GROUP BY category""")
def score_summary(spark, sf_dir):
    """Summary of the mean score over each question's top three."""
    from voltlattice.operators.metrics import retrieval_summary

    questions = fx.questions(spark, sf_dir)
    found = similarity.retrieve(questions, fx.vectors(spark, sf_dir), 3, -1.0)
    mean = found.groupBy("query_id").agg(F.avg("score").alias("score")).join(questions.select("query_id", "category"), "query_id")
    df = _summary(retrieval_summary(mean, prior(spark, sf_dir)))
    return df.withColumns({c: pround(c, 8) for c in ("new_min", "new_max")})
