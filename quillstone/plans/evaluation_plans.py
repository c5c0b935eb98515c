"""Queries that build evaluation sets and measure retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone import fixed_values as fixed
from quillstone.functions.text import lexical_features
from quillstone.operators import evalset as ev
from quillstone.operators import metrics as mt
from quillstone.operators import nearest as nn
from quillstone.operators import retrieval as rt
from quillstone.operators.chunking import chunk_document
from quillstone.plans import corpus as cp
from quillstone.plans import duck
from quillstone.plans.chunk_plans import DUCK_CHUNKS, SMALL
from quillstone.plans.inputs import DUCK_MARKDOWN_DOCS, markdown_docs
from quillstone.plans.registry import query
from quillstone.plans.retrieval_plans import DUCK_CROSS, DUCK_DECIDED, DUCK_HYBRID, hybrid_decided
from quillstone.session import work_dir
from quillstone.sources import files
from quillstone.sources.tables import read_questions, texts

# Latin texts end their sentences with other marks and use other words than the defaults.
ENDS = "。！？；.!?"
TERMS = ["tion", "ment", "keit", "ción"]
ANSWER_TERMS = ["tion", "ment"]
REASONS = ["the ", "die ", "que "]


def _duck_parts(x: str) -> str:
    marked = f"regexp_replace({x}, '([{ENDS}])', '\\1' || chr(1), 'g')"
    return f"list_transform(string_split({marked}, chr(1)), lambda s: {duck.normalize('s')})"


def _duck_plain(x: str) -> str:
    bare = duck.sub(duck.sub(duck.sub(x, "(?s)```.*?```|~~~.*?~~~"), f"https?://[^{duck.WS}]+"), "`([^`]+)`", "\\1")
    return f"list_filter({_duck_parts(bare)}, lambda s: length(s) BETWEEN 45 AND 260)"


DUCK_TERM_SENTENCES = (
    f"list_filter({_duck_parts(duck.normalize('content'))}, lambda s: length(s) BETWEEN 35 AND 180 AND {duck.any_of('s', TERMS)})"
)


@query(
    "sentence_split_terms",
    f"WITH {cp.DUCK_CORPUS} SELECT chunk_id, count(*) AS sentences, md5(string_agg(s, '|' ORDER BY i)) AS value FROM "
    f"(SELECT chunk_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM (SELECT chunk_id, {DUCK_TERM_SENTENCES} AS l FROM corpus)) GROUP BY chunk_id",
)
def sentence_split_terms(spark, folder):
    found = cp.corpus(spark, folder).select("chunk_id", ev.sentences_with_terms(F.col("content"), TERMS, ends=ENDS).alias("l"))
    return found.where(F.size("l") > 0).select(
        "chunk_id", F.size("l").cast("long").alias("sentences"), F.md5(F.array_join("l", "|")).alias("value")
    )


@query(
    "sentence_split_plain",
    f"WITH {cp.DUCK_CORPUS} SELECT chunk_id, len(l) AS sentences, md5(array_to_string(l, '|')) AS value FROM "
    f"(SELECT chunk_id, {_duck_plain('content')} AS l FROM corpus) WHERE len(l) > 0",
)
def sentence_split_plain(spark, folder):
    found = cp.corpus(spark, folder).select("chunk_id", ev.sentences_plain(F.col("content"), ends=ENDS).alias("l"))
    return found.where(F.size("l") > 0).select(
        "chunk_id", F.size("l").cast("long").alias("sentences"), F.md5(F.array_join("l", "|")).alias("value")
    )


def _duck_question(sentence: str, number: str, terms: list[str]) -> str:
    topic = "coalesce(list_filter([" + ", ".join(duck.text(t) for t in terms) + f"], lambda t: contains({sentence}, t))[1], '{fixed.CLUE_TOPIC_DEFAULT}')"
    joined = duck.sub(duck.compact(sentence), "[。！？；，,、]+", "，")
    clue = f"substr({duck.sub(joined, '^，+|，+$')}, 1, 46)"
    cases = " ".join(
        f"WHEN {i} THEN replace(replace({duck.text(t)}, '{{topic}}', {topic}), '{{clue}}', {clue})"
        for i, t in enumerate(fixed.CLUE_TEMPLATES)
    )
    return f"CASE {number} % 4 {cases} END"


DUCK_QUESTIONS = f"""
    {cp.DUCK_CORPUS},
    found AS (SELECT chunk_id, unnest(l) AS answer, unnest(range(len(l))) AS pos FROM (SELECT chunk_id, {DUCK_TERM_SENTENCES} AS l FROM corpus)),
    firsts AS (SELECT {duck.compact('answer')} AS key, arg_min(answer, (chunk_id, pos)) AS answer, min((chunk_id, pos)) AS place FROM found GROUP BY 1),
    built AS (SELECT row_number() OVER (ORDER BY place) AS number, answer, place[1] AS chunk_id FROM firsts)
"""


def all_questions(spark, folder):
    return ev.build_questions(cp.corpus(spark, folder), None, TERMS, ends=ENDS)


@query(
    "build_questions",
    f"""
    WITH {DUCK_QUESTIONS}
    SELECT 'rag-' || CASE WHEN number < 1000 THEN lpad(number::VARCHAR, 3, '0') ELSE number::VARCHAR END AS id, number,
           md5({_duck_question('answer', 'number', TERMS)}) AS question_md5, md5(answer) AS answer_md5, chunk_id AS relevant_chunk_id FROM built
    """,
)
def build_questions(spark, folder):
    return all_questions(spark, folder).select(
        "id", "number", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"), "relevant_chunk_id"
    )


@query("question_template", f"SELECT doc_id, {_duck_question('text', 'doc_id', TERMS)} AS question FROM documents")
def question_template(spark, folder):
    docs = texts(spark, folder, "documents")
    return docs.select("doc_id", ev.question_text(F.col("text"), F.col("doc_id"), TERMS).alias("question"))


BLOCKED = r"\n(#|[A-M])"


def _blocked_docs(spark, folder):
    return markdown_docs(spark, folder).select("doc_id", F.regexp_replace("text", BLOCKED, "\n\n$1").alias("content"))


DUCK_BLOCKED = f"blocked AS (SELECT doc_id, {duck.sub('text', BLOCKED, chr(10) * 2 + chr(92) + '1')} AS content FROM ({DUCK_MARKDOWN_DOCS}))"


@query(
    "good_chunk_filter",
    f"""
    WITH {DUCK_BLOCKED}
    SELECT doc_id, length(content) >= 180 AND len(list_filter(l, lambda x: {duck.starts_any(duck.strip('x'), fixed.CODE_LINE_STARTS)})) / len(l) < 0.15 AS good
    FROM (SELECT doc_id, content, string_split(content, chr(10)) AS l FROM blocked)
    """,
)
def good_chunk_filter(spark, folder):
    docs = _blocked_docs(spark, folder)
    return docs.select("doc_id", ev.good_chunk_filter(F.col("content"), min_han=0, max_code_share=0.15).alias("good"))


DUCK_BLOCKS = f"""
    {DUCK_BLOCKED},
    split_up AS (SELECT doc_id, length(content) AS size, list_filter(regexp_split_to_array(content, '\n{{2,}}'), lambda b: length({duck.strip('b')}) > 0) AS bs FROM blocked),
    blocks AS (SELECT doc_id, unnest(bs) AS block, unnest(range(len(bs))) AS block_no FROM split_up),
    lined AS (SELECT *, string_split(regexp_replace(block, '\n\\z', ''), chr(10)) AS l FROM blocks),
    stats AS (SELECT doc_id, block_no::INTEGER AS block_no, length(block)::INTEGER AS chars, 0 AS cjk,
                     len(list_filter(l, lambda x: {duck.starts_any(duck.strip('x'), fixed.BLOCK_CODE_STARTS)}))::INTEGER AS code_lines,
                     len(list_filter(l, lambda x: length(regexp_replace(x, '[^|]', '', 'g')) >= 2))::INTEGER AS table_lines,
                     len(list_filter(l, lambda x: regexp_matches(x, '^\\s*([-*+]|[0-9]+\\.)\\s+')))::INTEGER AS bullet_lines,
                     len(l)::INTEGER AS line_count FROM lined)
"""


@query("block_stats", f"WITH {DUCK_BLOCKS} SELECT * FROM stats")
def block_stats(spark, folder):
    return ev.block_stats(_blocked_docs(spark, folder), "doc_id")


@query(
    "technical_chunk_filter",
    f"""
    WITH {DUCK_BLOCKS}
    SELECT doc_id, size < 80 OR coalesce(code / n >= 0.55 OR tables / n >= 0.55, true) AS technical
    FROM split_up LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE code_lines >= greatest(2, line_count // 2)) AS code,
                                    count(*) FILTER (WHERE table_lines >= greatest(3, line_count // 2)) AS tables FROM stats GROUP BY doc_id) USING (doc_id)
    """,
)
def technical_chunk_filter(spark, folder):
    docs = _blocked_docs(spark, folder)
    return docs.select("doc_id", ev.technical_chunk_filter(F.col("content"), min_han=0).alias("technical"))


@query(
    "choose_answer_source",
    f"""
    WITH {cp.DUCK_CORPUS},
    s AS (SELECT chunk_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM (SELECT chunk_id, {_duck_plain('content')} AS l FROM corpus)),
    w AS (SELECT *, CASE WHEN {duck.any_of('s', ANSWER_TERMS)} THEN 3.0::DOUBLE ELSE 0.0 END + CASE WHEN {duck.any_of('s', REASONS)} THEN 2.0::DOUBLE ELSE 0.0 END
                    + least(length(s), 180) / 180.0::DOUBLE AS score FROM s)
    SELECT chunk_id, s AS answer_source FROM w QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, i) = 1
    """,
)
def choose_answer_source(spark, folder):
    best = ev.answer_source(F.col("content"), ANSWER_TERMS, REASONS, ends=ENDS)
    return cp.corpus(spark, folder).select("chunk_id", best.alias("answer_source")).where("answer_source IS NOT NULL")


@query(
    "section_sample",
    f"""
    WITH {cp.DUCK_CORPUS},
    p AS (SELECT chunk_id, kb_id || ' / ' || title AS path, min(chunk_id) OVER (PARTITION BY kb_id, title) AS first FROM corpus)
    SELECT chunk_id, path FROM p WHERE chunk_id = first OR ('0x' || substr(md5('42:' || chunk_id), 1, 8))::BIGINT < {2**30}
    ORDER BY md5('42/' || chunk_id), chunk_id LIMIT 200
    """,
)
def section_sample(spark, folder):
    chunks = cp.corpus(spark, folder).withColumn("heading_path", F.array("kb_id", "title"))
    picked = ev.section_sample(chunks, 100)
    return picked.select("chunk_id", F.array_join("heading_path", " / ").alias("path"))


def _duck_fallback() -> str:
    texts = " ".join(f"WHEN {i} THEN replace({duck.text(t)}, '{{heading}}', h)" for i, t in enumerate(fixed.HEADING_TEMPLATES))
    types = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(fixed.HEADING_TYPES))
    return f"CASE chunk_index % 4 {texts} END AS question, CASE chunk_index % 4 {types} END AS question_type"


@query(
    "fallback_questions",
    f"""
    WITH {DUCK_CHUNKS}
    SELECT doc_id, chunk_index, {_duck_fallback()}
    FROM (SELECT *, array_to_string(string_split(heading_path, ' > ')[-2:], ' / ') AS h FROM chunks)
    """,
)
def fallback_questions(spark, folder):
    chunks = chunk_document(markdown_docs(spark, folder), **SMALL)
    asked, kind = ev.fallback_question(F.col("heading_path"), F.col("chunk_index"))
    return chunks.select("doc_id", "chunk_index", asked.alias("question"), kind.alias("question_type"))


def _duck_long_run(a: str, b: str) -> str:
    return f"len(list_filter(range(length({a}) - 10), lambda i: contains({b}, substr({a}, i + 1, 11)))) > 0"


PAIR = {
    "q": ("substring_index(text, '\n', -1)", "regexp_extract(text, '([^\n]*)$', 1)"),
    "a": ("substring_index(text, '\n', 1)", "regexp_extract(text, '^([^\n]*)', 1)"),
}


@query(
    "validate_question",
    f"""
    WITH p AS (SELECT doc_id, {duck.normalize(PAIR['q'][1])} AS q, {duck.normalize(PAIR['a'][1])} AS a, CASE WHEN doc_id % 2 = 0 THEN text ELSE lang || source END AS s FROM documents),
    c AS (SELECT *, {duck.compact('q')} AS qc, {duck.compact('s')} AS sc FROM p)
    SELECT doc_id, length(q) BETWEEN 8 AND 120 AND length(a) >= 10 AND NOT {duck.any_of('q', fixed.BANNED_PHRASES)} AND NOT ({_duck_long_run('qc', 'sc')}) AS valid FROM c
    """,
)
def validate_question(spark, folder):
    docs = texts(spark, folder, "documents")
    last, first = F.substring_index("text", "\n", -1), F.substring_index("text", "\n", 1)
    source = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("lang", "source"))
    return docs.select("doc_id", ev.validate_question(last, first, source).alias("valid"))


# Three generated items per chunk, with every kind of fault in some of them.
ITEM = [
    "chunk_id",
    "position",
    "CASE position WHEN 0 THEN 'What about ' || kb_id || ' and ' || title || ' there' WHEN 1 THEN content ELSE 'Tell of ' || kb_id || ' / ' || title END AS question",
    "CASE WHEN chunk_id % 3 = 0 THEN content ELSE 'An answer about ' || kb_id END AS answer",
    "CASE WHEN chunk_id % 4 = 0 THEN upper(content) WHEN chunk_id % 4 = 1 THEN '' ELSE content END AS answer_source",
    "CASE WHEN chunk_id % 5 = 0 THEN chunk_id + 1 ELSE chunk_id END AS relevant_chunk_id",
    "CASE WHEN chunk_id % 6 = 0 THEN kb_id ELSE kb_id || '|' || title END AS heading",
    "CASE WHEN chunk_id % 7 = 0 THEN 'other' ELSE 'concept' END AS question_type",
]

DUCK_VALIDATED = f"""
    {cp.DUCK_CORPUS},
    items AS (SELECT {', '.join(ITEM)}, content, kb_id || '|' || title AS own_heading, kb_id || ' / ' || title AS path FROM corpus, range(3) r(position)),
    normed AS (SELECT *, {duck.normalize('question')} AS q, {duck.normalize('answer')} AS a FROM items),
    compacted AS (SELECT *, {duck.compact('q')} AS qc, {duck.compact('answer_source')} AS sc FROM normed),
    validated AS (SELECT *, CASE WHEN q = '' OR a = '' OR answer_source = '' THEN 'missing_field'
        WHEN length(q) NOT BETWEEN 8 AND 120 THEN 'question_length' WHEN length(a) NOT BETWEEN 10 AND 500 THEN 'answer_length'
        WHEN question_type NOT IN {duck.in_list(fixed.QUESTION_TYPES)} THEN 'question_type'
        WHEN {duck.any_of('q', fixed.BANNED_PHRASES)} THEN 'banned_phrase' WHEN contains(qc, {duck.compact('path')}) THEN 'heading_copied'
        WHEN {_duck_long_run('qc', 'sc')} THEN 'too_close_to_source' WHEN NOT contains(content, answer_source) THEN 'source_not_in_chunk'
        WHEN relevant_chunk_id <> chunk_id THEN 'wrong_chunk' WHEN heading <> own_heading THEN 'wrong_heading' END AS reject_reason FROM compacted)
"""


def validated_items(spark, folder):
    chunks = cp.corpus(spark, folder)
    items = chunks.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(2)))).selectExpr(*ITEM)
    items = items.withColumn("heading_path", F.split("heading", r"\|")).drop("heading")
    return ev.validate_item(items, chunks.withColumn("heading_path", F.array("kb_id", "title")))


@query(
    "validate_item",
    f"WITH {DUCK_VALIDATED} SELECT chunk_id, position::INTEGER AS position, reject_reason FROM validated",
)
def validate_item(spark, folder):
    return validated_items(spark, folder).select("chunk_id", "position", "reject_reason")


@query(
    "accept_items",
    f"""
    WITH {DUCK_VALIDATED}
    SELECT chunk_id, position::INTEGER AS position, md5(q) AS question_md5 FROM validated WHERE reject_reason IS NULL
    QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY position) <= 2
    """,
)
def accept_items(spark, folder):
    kept = ev.accept_items(validated_items(spark, folder))
    return kept.select("chunk_id", "position", F.md5("question").alias("question_md5"))


@query(
    "resume_pending",
    f"WITH {DUCK_QUESTIONS} SELECT chunk_id, doc_id FROM corpus WHERE chunk_id NOT IN (SELECT chunk_id FROM built)",
)
def resume_pending(spark, folder):
    return ev.resume_pending(cp.corpus(spark, folder), all_questions(spark, folder)).select("chunk_id", "doc_id")


@query("next_id", f"WITH {DUCK_QUESTIONS} SELECT max(number) + 1 AS next_id FROM built")
def next_id(spark, folder):
    return ev.next_id(all_questions(spark, folder), prefix="rag")


@query(
    "sink_eval",
    f"""
    WITH {DUCK_QUESTIONS}
    SELECT 'rag-' || CASE WHEN number < 1000 THEN lpad(number::VARCHAR, 3, '0') ELSE number::VARCHAR END AS id, md5(answer) AS answer_md5, chunk_id::VARCHAR AS relevant_chunk_id FROM built
    """,
)
def sink_eval(spark, folder):
    """The question set written as JSON lines and read back."""
    path = work_dir(spark, "evaluation")
    files.sink_eval(path, dataset=all_questions(spark, folder))
    rows = read_questions(spark, f"{path}/dataset")
    return rows.select("id", F.md5("answer").alias("answer_md5"), "relevant_chunk_id")


# Metrics.

DUCK_HIT = f"contains({duck.compact('content')}, {duck.compact('answer_source')})"
DUCK_MARKED = f"""
    {DUCK_DECIDED},
    marked AS (SELECT d.*, h.rerank_score, h.distance, {DUCK_HIT} AS contains_answer FROM decided d
               JOIN (SELECT query_id, chunk_id, rerank_score, distance, content, answer_source FROM hybrid) h USING (query_id, chunk_id))
"""


def _duck_metrics(questions: str, hits: str, k: int, keys: str = "", group: str = "") -> str:
    """Per-question rows of ``hits`` (query_id, rank, contains_answer), then means."""
    return f"""
    SELECT {keys} count(*) AS question_count, round(avg(h1), 6) AS hit_rate_at_1, round(avg(hk), 6) AS hit_rate_at_k, round(avg(hk), 6) AS recall_at_k,
           round(avg(p), 6) AS precision_at_k, round(avg(rr), 6) AS mrr, round(avg(n), 6) AS mean_selected_count
    FROM (SELECT q.*, CASE WHEN first_hit = first_any THEN 1.0 ELSE 0.0 END AS h1, CASE WHEN coalesce(rel, 0) > 0 THEN 1.0 ELSE 0.0 END AS hk,
                 coalesce(rel, 0) / {k}::DOUBLE AS p, coalesce(1.0 / first_hit, 0) AS rr, coalesce(n, 0) AS n
          FROM {questions} q LEFT JOIN (SELECT query_id, min(rank) FILTER (WHERE contains_answer) AS first_hit, min(rank) AS first_any,
                 count(*) FILTER (WHERE contains_answer) AS rel, count(*) AS n FROM {hits} GROUP BY query_id) USING (query_id)) {group}
    """


ROUNDED = ["hit_rate_at_1", "hit_rate_at_k", "recall_at_k", "precision_at_k", "mrr", "mean_selected_count"]


def _rounded(df, names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def marked(spark, folder):
    return mt.mark_hits(hybrid_decided(spark, folder))


@query(
    "mark_hits",
    f"WITH RECURSIVE {DUCK_MARKED} SELECT query_id, chunk_id, contains_answer FROM marked",
)
def mark_hits(spark, folder):
    return marked(spark, folder).select("query_id", "chunk_id", "contains_answer")


@query(
    "retrieval_metrics",
    f"WITH RECURSIVE {DUCK_MARKED} {_duck_metrics('questions', '(SELECT * FROM marked WHERE NOT filtered)', 3)}",
)
def retrieval_metrics(spark, folder):
    return _rounded(mt.retrieval_metrics(cp.questions(spark, folder), marked(spark, folder), 3), ROUNDED)


TYPE = "CASE query_id % 3 WHEN 0 THEN 'concept' WHEN 1 THEN 'scenario' ELSE 'comparison' END"


def typed_questions(spark, folder):
    return cp.questions(spark, folder).withColumn("question_type", F.expr(TYPE))


@query(
    "metrics_by_type",
    f"""
    WITH RECURSIVE {DUCK_MARKED}, typed AS (SELECT *, {TYPE} AS question_type FROM questions)
    {_duck_metrics('typed', '(SELECT * FROM marked WHERE NOT filtered)', 3, 'question_type,', 'GROUP BY ROLLUP (question_type)')}
    """,
)
def metrics_by_type(spark, folder):
    return _rounded(mt.metrics_by_type(typed_questions(spark, folder), marked(spark, folder), 3), ROUNDED)


@query(
    "type_distribution",
    f"SELECT {TYPE.replace('query_id', 'item_id')} AS question_type, count(*) AS questions FROM benchmark GROUP BY 1",
)
def type_distribution(spark, folder):
    return mt.type_distribution(typed_questions(spark, folder))


@query(
    "labelled_metrics",
    f"""
    WITH {DUCK_HYBRID},
    m AS (SELECT query_id, rerank, (query_id + chunk_id) % 4 = 0 AS hit FROM hybrid),
    p AS (SELECT query_id, count(*) FILTER (WHERE rerank <= 3) AS got, count(*) FILTER (WHERE rerank <= 3 AND hit) AS rel,
                 min(rerank) FILTER (WHERE hit) AS first, count(*) FILTER (WHERE hit) AS lab FROM m GROUP BY query_id)
    SELECT round(sum(rel) / sum(got), 6) AS precision_at_k, round(sum(rel) / sum(lab), 6) AS recall_at_k,
           round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_at_1, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM p
    """,
)
def labelled_metrics(spark, folder):
    ranked = rt.hybrid_rerank(cp.candidates(spark, folder)).select("query_id", "chunk_id", F.col("rerank").alias("rank"))
    labels = ranked.where((F.col("query_id") + F.col("chunk_id")) % 4 == 0).select("query_id", "chunk_id")
    return _rounded(mt.labelled_metrics(ranked, labels, 3), ["precision_at_k", "recall_at_k", "hit_rate_at_1", "mrr"])


METHODS = ["vector", "hybrid", "cross"]


@query(
    "method_compare",
    f"""
    WITH {DUCK_HYBRID}, {DUCK_CROSS.split(cp.DUCK_CANDIDATES)[1].lstrip().lstrip(',')},
    hits AS (SELECT 'vector' AS method, query_id, raw_rank AS rank, {DUCK_HIT} AS contains_answer FROM hybrid WHERE raw_rank <= 3
       UNION ALL SELECT 'hybrid', query_id, rerank, {DUCK_HIT} FROM hybrid WHERE rerank <= 3
       UNION ALL SELECT 'cross', query_id, rerank, {DUCK_HIT} FROM crossed WHERE rerank <= 3),
    asked AS (SELECT method, query_id FROM questions, (VALUES ('vector'), ('hybrid'), ('cross')) v(method)),
    per AS (SELECT method, query_id, min(rank) FILTER (WHERE contains_answer) AS f, count(*) FILTER (WHERE contains_answer) AS rel, count(rank) AS n
            FROM asked LEFT JOIN hits USING (method, query_id) GROUP BY ALL),
    long AS (SELECT method, 'hit_rate_at_1' AS metric, avg(CASE WHEN f = 1 THEN 1.0 ELSE 0 END) AS v FROM per GROUP BY 1
       UNION ALL SELECT method, 'recall_at_k', avg(CASE WHEN rel > 0 THEN 1.0 ELSE 0 END) FROM per GROUP BY 1
       UNION ALL SELECT method, 'precision_at_k', avg(rel / 3.0) FROM per GROUP BY 1
       UNION ALL SELECT method, 'mrr', avg(coalesce(1.0 / f, 0)) FROM per GROUP BY 1
       UNION ALL SELECT method, 'mean_selected_count', avg(n) FROM per GROUP BY 1)
    SELECT metric, round(max(v) FILTER (WHERE method = 'vector'), 6)::DOUBLE AS vector, round(max(v) FILTER (WHERE method = 'hybrid'), 6)::DOUBLE AS hybrid,
           round(max(v) FILTER (WHERE method = 'cross'), 6)::DOUBLE AS "cross",
           round(max(v) FILTER (WHERE method = 'cross') - max(v) FILTER (WHERE method = 'hybrid'), 6)::DOUBLE AS delta FROM long GROUP BY metric
    """,
)
def method_compare(spark, folder):
    rows = cp.candidates(spark, folder)
    asked = cp.questions(spark, folder)
    ranked = {"vector": rt.vector_rank(rows), "hybrid": rt.hybrid_rerank(rows), "cross": rt.cross_rerank(rows)}
    summaries = []
    for name, hits in ranked.items():
        top = mt.mark_hits(hits.where("rerank <= 3").withColumn("rank", F.col("rerank")))
        summaries.append(mt.retrieval_metrics(asked, top, 3).withColumn("method", F.lit(name)))
    wide = mt.method_compare(mt.union_all(summaries), "hybrid", "cross", METHODS)
    return _rounded(wide, [*METHODS, "delta"])


def scored(spark, folder):
    """Every raw candidate with its model score and whether it holds the answer."""
    ranked = rt.cross_rerank(cp.candidates(spark, folder))
    return mt.mark_hits(ranked).withColumn("rerank_score", F.round("rerank_score", 6))


DUCK_SCORED = f"""
    {DUCK_CROSS},
    scores AS (SELECT query_id, chunk_id, raw_rank, rerank, round(rerank_score, 6) AS rerank_score, {DUCK_HIT} AS contains_answer FROM crossed)
"""


@query(
    "score_distribution",
    f"""
    WITH {DUCK_SCORED}
    SELECT CASE WHEN contains_answer THEN 'positive' ELSE 'negative' END AS class, count(*) AS count, min(rerank_score) AS min, max(rerank_score) AS max,
           round(avg(rerank_score), 6) AS mean,
           {', '.join(f"round(quantile_cont(rerank_score, {p / 100}), 6) AS p{p}" for p in mt.PERCENTS)}
    FROM scores GROUP BY 1
    """,
)
def score_distribution(spark, folder):
    out = mt.score_distribution(scored(spark, folder))
    return _rounded(out, ["mean", *[f"p{p}" for p in mt.PERCENTS]])


@query(
    "score_auc",
    f"""
    WITH {DUCK_SCORED},
    p AS (SELECT rerank_score AS s FROM scores WHERE contains_answer), n AS (SELECT rerank_score AS s FROM scores WHERE NOT contains_answer)
    SELECT (SELECT count(*) FROM p) AS positives, (SELECT count(*) FROM n) AS negatives,
           round(avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END), 6) AS auc FROM p, n
    """,
)
def score_auc(spark, folder):
    return _rounded(mt.score_auc(scored(spark, folder), "rerank_score", "contains_answer"), ["auc"])


THRESHOLDS = [None, 0.0, 0.5, 1.0, 1.5, 2.0]


@query(
    "threshold_sweep",
    f"""
    WITH {DUCK_SCORED},
    t AS (SELECT * FROM (VALUES ('none', NULL), ('0.0', 0.0), ('0.5', 0.5), ('1.0', 1.0), ('1.5', 1.5), ('2.0', 2.0)) v(threshold, x)),
    per AS (SELECT threshold, q.query_id, count(*) FILTER (WHERE k AND raw_rank <= 3) AS inj, count(*) FILTER (WHERE k AND raw_rank <= 3 AND contains_answer) AS rel,
                   count(*) FILTER (WHERE k AND contains_answer) AS pk, count(*) FILTER (WHERE k AND NOT contains_answer) AS nk,
                   count(*) FILTER (WHERE contains_answer) AS p, count(*) FILTER (WHERE NOT contains_answer) AS n
            FROM t CROSS JOIN questions q LEFT JOIN (SELECT * FROM scores) s USING (query_id), LATERAL (SELECT x IS NULL OR rerank_score >= x AS k) GROUP BY ALL)
    SELECT threshold, round(avg(CASE WHEN rel > 0 THEN 1.0 ELSE 0 END), 6) AS recall_at_k, round(avg(CASE WHEN inj > 0 THEN 1.0 ELSE 0 END), 6) AS kept_any,
           round(avg(inj), 6) AS mean_injected, round(sum(rel) / nullif(sum(inj), 0), 6) AS precision,
           round(sum(pk) / nullif(sum(p), 0), 6) AS positive_retention, round(sum(nk) / nullif(sum(n), 0), 6) AS negative_retention
    FROM per GROUP BY threshold
    """,
)
def threshold_sweep(spark, folder):
    rows = scored(spark, folder).withColumnRenamed("rerank_score", "score_value")
    out = mt.threshold_sweep(rows, cp.questions(spark, folder), THRESHOLDS, 3)
    return _rounded(out, ["recall_at_k", "kept_any", "mean_injected", "precision", "positive_retention", "negative_retention"])


@query(
    "labelled_pairs",
    f"""
    WITH {DUCK_SCORED}, r AS (SELECT query_id, coalesce(min(chunk_id) FILTER (WHERE contains_answer), -1) AS rel FROM scores GROUP BY query_id)
    SELECT query_id, chunk_id, chunk_id = rel AS positive, rerank_score AS score FROM scores JOIN r USING (query_id)
    """,
)
def labelled_pairs(spark, folder):
    rows = scored(spark, folder)
    relevant = rows.groupBy("query_id").agg(
        F.coalesce(F.min(F.when(F.col("contains_answer"), F.col("chunk_id"))), F.lit(-1)).alias("relevant_chunk_id")
    )
    return mt.labelled_pairs(relevant, rows.select("query_id", "chunk_id", F.col("rerank_score").alias("score")))


@query(
    "score_histogram",
    f"""
    WITH {DUCK_SCORED},
    e AS (SELECT floor(min(rerank_score) / 0.5)::BIGINT AS lo, ceil(max(rerank_score) / 0.5)::BIGINT AS hi FROM scores),
    b AS (SELECT unnest(range(lo, hi)) AS bin, hi FROM e)
    SELECT bin * 0.5::DOUBLE AS lower, (bin + 1) * 0.5::DOUBLE AS upper, count(rerank_score) AS count
    FROM b LEFT JOIN scores ON rerank_score >= bin * 0.5 AND (rerank_score < (bin + 1) * 0.5 OR (bin = hi - 1 AND rerank_score = hi * 0.5)) GROUP BY bin
    """,
)
def score_histogram(spark, folder):
    return mt.score_histogram(scored(spark, folder), "rerank_score")


@query(
    "score_kde",
    f"""
    WITH {DUCK_SCORED},
    e AS (SELECT floor(min(rerank_score) / 0.5) * 0.5 AS lo, ceil(max(rerank_score) / 0.5) * 0.5 AS hi, count(*) AS n,
                 power(count(*), -0.2) * stddev_samp(rerank_score) AS h FROM scores)
    SELECT i::INTEGER AS i, round(any_value(lo + i * (hi - lo) / 499), 6) AS x,
           round(sum(exp(-0.5 * power((lo + i * (hi - lo) / 499 - rerank_score) / h, 2)) / (n * h * sqrt(2 * pi()))), 6) AS density
    FROM scores, e, range(500) r(i) GROUP BY i
    """,
)
def score_kde(spark, folder):
    return _rounded(mt.score_kde(scored(spark, folder), "rerank_score"), ["x", "density"])


@query(
    "answer_passage_retrieval",
    f"""
    WITH {cp.DUCK_CORPUS},
    cf AS (SELECT chunk_id, content, {duck.features('content')} AS f FROM corpus),
    qf AS (SELECT *, {duck.features('query')} AS q FROM questions),
    best AS (SELECT query_id, chunk_id, content, answer_source, len(list_intersect(q, f)) / len(q) AS s,
                    row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM qf CROSS JOIN cf QUALIFY rank <= 3),
    hits AS (SELECT query_id, rank, {DUCK_HIT} AS contains_answer FROM best)
    {_duck_metrics('questions', 'hits', 3)}
    """,
)
def answer_passage_retrieval(spark, folder):
    """Flagship: every question against every chunk by lexical score, the three best marked and measured."""
    asked = cp.questions(spark, folder)
    chunks = cp.corpus(spark, folder).select("chunk_id", lexical_features("content").alias("features"))
    found = nn.lexical_topk(chunks, asked.select("query_id", lexical_features("query").alias("features")), 3)
    hits = mt.mark_hits(cp.with_chunk_rows(found, spark, folder).join(asked, "query_id"))
    return _rounded(mt.retrieval_metrics(asked, hits, 3), ROUNDED)
