"""Cleaning, tokens, lemmas, term weights, embeddings, keywords and payloads over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataquarry.functions.text import clean_text as clean
from dataquarry.functions.text import raw_tokens
from dataquarry.functions.text import tokenize as split_tokens
from dataquarry.operators import text as X
from dataquarry.operators import topics as T
from dataquarry.runtime import materialise, spread
from queryset.common import TOPIC_SQL, Registry, docs_topic, rnd, sql_words, table

REGISTRY = Registry()

WORDS = f"select doc_id, {sql_words('text')} as words from documents"
TOPIC_WORDS = f"{TOPIC_SQL}, w as (select topic, {sql_words('text')} as words from docs where topic <> -1)"
TERMS = "list_filter(words, lambda t: length(t) >= 2)"


def terms(column="text"):
    """Tokens of a raw text column."""
    return raw_tokens(F.col(column))


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


@REGISTRY.add("clean_text", f"with w as ({WORDS}) select doc_id, array_to_string(words, ' ') as text_clean from w")
def clean_text(spark, sf):
    return X.add_clean_text(docs(spark, sf), "text").drop("text")


@REGISTRY.add("tokenize", f"""
with w as (select conv_id, turn, {sql_words('text')} as words from conversations)
select conv_id, turn, array_to_string({TERMS}, ' ') as tokens, len({TERMS}) as n from w""")
def tokenise(spark, sf):
    df = spread(table(spark, sf, "conversations")).withColumn("t", split_tokens(clean(F.col("text"))))
    return df.select("conv_id", "turn", F.array_join("t", " ").alias("tokens"), F.size("t").cast("bigint").alias("n"))


@REGISTRY.add("lemmatize", f"""
with w as ({WORDS}),
 t as (select doc_id, unnest(words) as token, unnest(range(1, len(words) + 1)) as pos from w),
 u as (select distinct token from t),
 stops as (select token from u where md5(token) < '2'),
 lemmas as (select token, substr(token, 1, 4) as lemma from u where length(token) > 6),
 x as (select doc_id, pos, coalesce(lemma, t.token) as token from t anti join stops using (token) left join lemmas using (token))
select d.doc_id, coalesce(string_agg(x.token, ' ' order by pos), '') as lemmatized from documents d left join x using (doc_id) group by 1""")
def lemmatize(spark, sf):
    """Stop and lemma tables derived by a rule from the corpus vocabulary."""
    # Written: both tables derive from the vocabulary, and that from the texts.
    df = materialise(X.add_clean_text(docs(spark, sf), "text").select("doc_id", "text_clean"), "cleaned")
    words = df.select(F.explode(F.split("text_clean", " ")).alias("token")).filter("token <> ''")
    vocabulary = materialise(words.distinct(), "vocabulary")
    stops = vocabulary.filter(F.md5("token") < "2")
    lemmas = vocabulary.filter(F.length("token") > 6).withColumn("lemma", F.substring("token", 1, 4))
    return X.lemmatize(df, "doc_id", "text_clean", lemmas, stops).select("doc_id", "lemmatized")


@REGISTRY.add("term_counts", f"""with {TOPIC_WORDS}
select topic, t.term, count(*) as n from w, unnest({TERMS}) t(term) group by 1, 2""")
def term_counts(spark, sf):
    return X.term_counts(spread(docs_topic(spark, sf).filter("topic <> -1")), "topic", terms())


@REGISTRY.add("document_frequency", f"""with w as ({WORDS}), t as (select doc_id, unnest({TERMS}) as term from w)
select term, count(distinct doc_id) as df, count(*) as total from t group by 1""")
def document_frequency(spark, sf):
    return X.document_frequency(docs(spark, sf), terms())


_TFIDF = f"""w as ({WORDS}), t as (select doc_id, unnest({TERMS}) as term from w),
 tf as (select doc_id, term, count(*) as tf from t group by 1, 2),
 df as (select term, count(*) as df, sum(tf) as total from tf group by 1),
 n as (select count(*) as n from documents),
 voc as (select term, ln((1 + n) / (1 + df)) + 1 as idf from df, n where df >= 5 and df <= 0.9 * n order by total desc, term limit 5000),
 x as (select doc_id, term, tf * idf as w from tf join voc using (term))"""


@REGISTRY.add("tfidf", f"with {_TFIDF} select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from x")
def tfidf(spark, sf):
    return X.tfidf(docs(spark, sf), "doc_id", terms()).withColumn("weight", rnd("weight", 6))


@REGISTRY.add("embed_text", f"""with w as ({WORDS}), t as (select doc_id, unnest({TERMS}) as term from w),
 h as (select doc_id, cast('0x' || substr(md5(term), 1, 8) as bigint) % 384 as dim,
   case when substr(md5(term), 9, 1) < '8' then 1 else -1 end as sign from t),
 s as (select doc_id, dim, sum(sign) as v from h group by 1, 2)
select doc_id, cast(dim as integer) as dim, round(v / sqrt(sum(v * v) over (partition by doc_id)), 6) as x from s where v <> 0""")
def embed_text(spark, sf):
    out = X.embed_text(docs(spark, sf), terms())
    return out.select("doc_id", F.posexplode_outer("embedding").alias("dim", "x")).filter("x <> 0").withColumn("x", rnd("x", 6))


@REGISTRY.add("encode_text", """
select item_id, length(text) as n_chars, length(text) - length(replace(text, ' ', '')) as n_blanks from benchmark""")
def encode_text(spark, sf):
    """A user's encoder, run in batches per worker: here lengths and blanks of whole texts."""
    def load():
        return lambda batch: [[len(t), t.count(" ")] for t in batch]

    out = X.encode_text(table(spark, sf, "benchmark"), "item_id", "text", load)
    e = F.col("embedding")
    return out.select("item_id", e[0].cast("bigint").alias("n_chars"), e[1].cast("bigint").alias("n_blanks"))


_CLASS = f"""{TOPIC_WORDS}, t as (select topic, unnest({TERMS}) as term from w),
 tf as (select topic, term, count(*) as tf from t group by 1, 2), n as (select count(distinct topic) as n from w),
 top as (select term, ln((1 + n) / (1 + count(*))) + 1 as idf from tf, n group by term, n order by sum(tf) desc, term limit 10),
 grid as (select g.topic, top.term, coalesce(tf, 0) * idf as w from (select distinct topic from w) g cross join top left join tf using (topic, term)),
 sc as (select topic, term, case when sum(w * w) over (partition by topic) > 0 then w / sqrt(sum(w * w) over (partition by topic)) else 0 end as score from grid),
 rk as (select topic, row_number() over (partition by topic order by round(score, 9) desc, term desc) as rank, term, score from sc)"""


@REGISTRY.add("class_tfidf_keywords", f"with {_CLASS} select topic, cast(rank as integer) as rank, term, round(score, 6) as score from rk where rank <= 10")
def class_tfidf_keywords(spark, sf):
    out = T.class_tfidf_keywords(spread(docs_topic(spark, sf)), "topic", terms())
    return out.withColumn("score", rnd("score", 6))


@REGISTRY.add("topic_keywords", f"""with {TOPIC_WORDS}, t as (select topic, unnest({TERMS}) as term from w),
 tf as (select topic, term, count(*) as score from t group by 1, 2),
 rk as (select topic, row_number() over (partition by topic order by score desc, term desc) as rank, term, score from tf)
select topic, cast(rank as integer) as rank, term, score from rk where rank <= 10""")
def topic_keywords(spark, sf):
    """Ranking by plain counts: many ties, resolved in reverse alphabetical order."""
    counts = X.term_counts(spread(docs_topic(spark, sf).filter("topic <> -1")), "topic", terms())
    return T.topic_keywords(counts.withColumnRenamed("n", "score"), "topic")


@REGISTRY.add("class_tfidf_per_topic", f"""with {TOPIC_WORDS}, t as (select topic, unnest({TERMS}) as term from w),
 tf as (select topic, term, count(*) as tf from t group by 1, 2), n as (select count(distinct topic) as n from w),
 idf as (select term, ln((1 + n) / (1 + count(*))) + 1 as idf from tf, n group by term, n),
 x as (select topic, term, tf * idf as w from tf join idf using (term))
select topic, term, round(w / sqrt(sum(w * w) over (partition by topic)), 6) as score from x""")
def class_tfidf_per_topic(spark, sf):
    out = T.class_tfidf(spread(docs_topic(spark, sf)), "topic", terms(), vocab="per_topic")
    return out.withColumn("score", rnd("score", 6))


@REGISTRY.add("topic_payload", f"""with {_CLASS},
 kw as (select topic, string_agg(term, '|' order by rank) as keywords from rk where rank <= 10 group by 1),
 sm as (select topic, text, row_number() over (partition by topic order by md5('42' || cast(doc_id as varchar)), doc_id) as r from docs where topic <> -1),
 cx as (select topic, string_agg(text, '|' order by r) as context from sm where r <= 3 group by 1)
select topic, keywords, context from kw left join cx using (topic)""")
def topic_payload(spark, sf):
    out = T.topic_payload(spread(docs_topic(spark, sf)), "topic", "doc_id", "text", terms())
    return out.select("topic", F.array_join("keywords", "|").alias("keywords"), F.array_join("context", "|").alias("context"))
