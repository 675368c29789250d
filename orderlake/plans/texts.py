"""Review texts: cleaning, keywords, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlake.functions import bayes, scoring, text
from orderlake.plans.twins import sql
from orderlake.sources import adapters as A

#: Words that say little.
STOP_WORDS = "the and for are was with that this from have has had not but you they his her its our their der die das und ist von den mit ein eine les des est une que qui dans pour par sur los las una del con para por".split()
LONG = 400


def messages(spark, sf):
    return text.melt(A.review(spark, sf))


def clean_text(spark, sf):
    """The whole job: all steps, and the hand-made corrections beside the tables."""
    return text.preprocess(A.review(spark, sf), text.fixes(spark, f"{sf.rstrip('/')}/manual_fix_reviews.json"))


def clean_basic(spark, sf):
    return text.clean_rows(messages(spark, sf), "text", text.BASIC)


def outliers(spark, sf):
    """Texts of which the form that goes to a model, each line once, differs by more than so many characters."""
    output = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    sizes = messages(spark, sf).select("review_id", "message_type", F.length("text").alias("n_source"), F.length(output).alias("n_output"))
    return sizes.withColumn("difference", F.abs(F.col("n_source") - F.col("n_output"))).where(F.col("difference") > LONG)


def distinct_texts(spark, sf):
    """The cleaned texts alone, each once, the longest first."""
    return clean_basic(spark, sf).select("text").distinct().select("text", F.length("text").alias("n_chars")).orderBy(F.desc("n_chars"), "text")


def clean_texts_distinct(spark, sf):
    """The texts alone of the whole job, all steps and hand-made corrections, each once, the longest first."""
    return text.texts(clean_text(spark, sf))


#: What a text is judged to be; the scores are shares of one.
LABELS = ["good", "poor", "toxic"]


def labelled(spark, sf):
    """Documents with their label, without every fourth, by the MD5 of their number, which is held out."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    rows = A.raw(spark, sf, "documents").join(A.raw(spark, sf, "labels").select("doc_id", kind.alias("label")), "doc_id")
    return rows.select("doc_id", "text", "label").where(~held_out("doc_id"))


def held_out(key: str):
    return F.substring(F.md5(F.col(key).cast("string")), 1, 1) < "4"


#: Rows that the model of ``score_batches`` and ``score_join_back`` is fitted on at most, as their SQL has it; the others' is fitted on all.
FITTED = 100_000


def judge(spark, sf, most: int | None = FITTED):
    """A maker of the model that is fitted on them: on so many at most, or on all."""
    return bayes.maker(bayes.fit(labelled(spark, sf), "text", "label", LABELS, "doc_id", most))


def score_batches(spark, sf):
    texts = messages(spark, sf).select("text").distinct()
    return scoring.score(texts, "text", judge(spark, sf), LABELS).select(F.md5("text").alias("text_md5"), *[F.round(x, 4).alias(x) for x in LABELS])


def scored(spark, sf, most: int | None = FITTED):
    return scoring.score_distinct(messages(spark, sf), "text", judge(spark, sf, most), LABELS)


def score_join_back(spark, sf):
    return scored(spark, sf).select("review_id", "message_type", *[F.round(x, 4).alias(x) for x in LABELS])


def argmax_label(spark, sf):
    """The likeliest label of each text, by the model of all labelled documents."""
    return scored(spark, sf, None).select("review_id", "message_type", scoring.best_label(LABELS).alias("label"))


def held_out_accuracy(spark, sf):
    """Of the held-out documents of each label: how many there are, and how many get it from the model."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    rows = A.raw(spark, sf, "documents").join(A.raw(spark, sf, "labels").select("doc_id", kind.alias("label")), "doc_id").where(held_out("doc_id")).select("text", "label")
    told = scoring.score_distinct(rows, "text", judge(spark, sf, None), LABELS).withColumn("found", scoring.best_label(LABELS))
    return told.groupBy("label").agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("found") == F.col("label"), 1)).alias("n_right"))


QUERIES = {
    "review_melt": messages,
    "clean_text": clean_text,
    "clean_text_basic": clean_basic,
    "keyword_counts": lambda s, d: text.keywords(A.raw(s, d, "documents"), "text", STOP_WORDS),
    "keyword_counts_distinct": lambda s, d: text.keywords(A.raw(s, d, "documents").select("text").distinct(), "text", STOP_WORDS),
    "clean_text_distinct": distinct_texts,
    "text_outliers": outliers,
    "score_batches": score_batches,
    "score_join_back": score_join_back,
    "argmax_label": argmax_label,
    "held_out_accuracy": held_out_accuracy,
    "clean_texts_distinct": clean_texts_distinct,
}
MELT = "SELECT review_id, 'title' AS message_type, review_comment_title AS text FROM b_review WHERE review_comment_title IS NOT NULL UNION ALL SELECT review_id, 'message', review_comment_message FROM b_review WHERE review_comment_message IS NOT NULL"
CLEANED = "regexp_replace(trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(lower(text), '[\r\n]', ' ', 'g'), '[`´\"“”‘’''*^]', '''', 'g'), '!', '.'), '\\s+([!?.,])', '\\1', 'g'), '\\s+', ' ', 'g')), '[.,+]+$', '')"
TOLD = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label"
BUCKETS = "SELECT DISTINCT {0}, substr(md5(CASE WHEN regexp_full_match(w, '[A-Z]{{4,}}') THEN 'CAPS' ELSE lower(w) END), 1, 4) AS b FROM (SELECT {0}, unnest(regexp_extract_all(text, '[#*$%&|<>]|[A-Za-z]+')) AS w FROM {1})"
#: The model by counts, and its scores of the texts in t_texts.
BAYES = {
    "t_kind": f"SELECT doc_id, text, {TOLD}, substr(md5(doc_id::VARCHAR), 1, 1) < '4' AS held FROM documents JOIN labels USING (doc_id)",
    "t_fit": "SELECT doc_id, text, label FROM t_kind WHERE NOT held ORDER BY md5(doc_id::VARCHAR) LIMIT 100000",
    "t_label": "SELECT x.label, count(t_fit.label) AS n, (SELECT count(*) FROM t_fit) AS total, ln((count(t_fit.label) + 1) / ((SELECT count(*) FROM t_fit) + 3)) AS prior FROM (VALUES ('good'), ('poor'), ('toxic')) AS x(label) LEFT JOIN t_fit USING (label) GROUP BY x.label",
    "t_count": f"SELECT label, b, count(*) AS n FROM ({BUCKETS.format('doc_id, label', 't_fit')}) GROUP BY 1, 2",
    "t_often": "SELECT l.label, a.b, a.all_n, a.all_n / l.total AS share, (coalesce(c.n, 0) + a.all_n / l.total) / (l.n + 1) AS often FROM (SELECT b, sum(n) AS all_n FROM t_count GROUP BY b) AS a CROSS JOIN t_label AS l LEFT JOIN t_count AS c ON c.label = l.label AND c.b = a.b",
    "t_weight": "SELECT label, b, ln(often) AS weight FROM (SELECT *, max(often) OVER (PARTITION BY b) AS most FROM t_often) WHERE all_n >= 10 AND most >= 4 * share",
    "t_has": BUCKETS.format("text", "t_texts"),
    "t_log": "SELECT text, label, prior + coalesce(s, 0) AS l FROM (SELECT text, label, prior FROM t_texts, t_label) LEFT JOIN (SELECT text, label, sum(weight) AS s FROM t_has JOIN t_weight USING (b) GROUP BY 1, 2) USING (text, label)",
    "t_score": "SELECT text, max(CASE WHEN label = 'good' THEN p END) AS good, max(CASE WHEN label = 'poor' THEN p END) AS poor, max(CASE WHEN label = 'toxic' THEN p END) AS toxic FROM (SELECT text, label, exp(l - max(l) OVER (PARTITION BY text)) / sum(exp(l - m)) OVER (PARTITION BY text) AS p FROM (SELECT *, max(l) OVER (PARTITION BY text) AS m FROM t_log)) GROUP BY text",
    "t_best": "SELECT text, good, poor, toxic, CASE WHEN toxic >= poor AND toxic >= good THEN 'toxic' WHEN poor >= good THEN 'poor' ELSE 'good' END AS label FROM t_score",
}
#: The same with the model of all labelled documents.
BAYES_ALL = BAYES | {"t_fit": "SELECT doc_id, text, label FROM t_kind WHERE NOT held"}
ROUNDED = "round(good, 4) AS good, round(poor, 4) AS poor, round(toxic, 4) AS toxic"
KEYWORDS = "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z\\s]', '', 'g'), '\\s+')) AS word FROM (SELECT DISTINCT text FROM documents)) WHERE length(word) > 2 AND word NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ") GROUP BY 1 ORDER BY n DESC, word LIMIT 20"
ORACLE_SQL = {
    "keyword_counts_distinct": KEYWORDS,
    "clean_text_distinct": sql(f"SELECT t AS text, length(t)::INT AS n_chars FROM (SELECT DISTINCT {CLEANED} AS t FROM t_melt) WHERE t <> ''", t_melt=MELT),
    "review_melt": sql(MELT),
    "clean_text_basic": sql(f"SELECT review_id, message_type, t AS text FROM (SELECT review_id, message_type, {CLEANED} AS t FROM t_melt) WHERE t <> ''", t_melt=MELT),
    "keyword_counts": "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z\\s]', '', 'g'), '\\s+')) AS word FROM documents) WHERE length(word) > 2 AND word NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ") GROUP BY 1 ORDER BY n DESC, word LIMIT 20",
    "text_outliers": sql(f"SELECT * FROM (SELECT review_id, message_type, length(text)::INT AS n_source, length(o)::INT AS n_output, abs(length(text) - length(o))::INT AS difference FROM (SELECT *, (SELECT string_agg(x, chr(10) ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i) GROUP BY x)) AS o FROM t_melt)) WHERE difference > {LONG}", t_melt=MELT),
    "score_batches": sql(f"SELECT md5(text) AS text_md5, {ROUNDED} FROM t_score", t_melt=MELT, t_texts="SELECT DISTINCT text FROM t_melt", **BAYES),
    "score_join_back": sql(f"SELECT review_id, message_type, {ROUNDED} FROM t_melt JOIN t_score USING (text)", t_melt=MELT, t_texts="SELECT DISTINCT text FROM t_melt", **BAYES),
    "argmax_label": sql("SELECT review_id, message_type, label FROM t_melt JOIN t_best USING (text)", t_melt=MELT, t_texts="SELECT DISTINCT text FROM t_melt", **BAYES_ALL),
    "held_out_accuracy": sql("SELECT k.label, count(*) AS n_rows, count(*) FILTER (k.label = t.label) AS n_right FROM t_kind AS k JOIN t_best AS t USING (text) WHERE held GROUP BY 1", t_texts="SELECT DISTINCT text FROM t_kind WHERE held", **BAYES_ALL),
}
