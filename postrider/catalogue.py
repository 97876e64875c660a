"""The registered queries of the archive engine, each beside the DuckDB SQL it is checked with."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import charset, documents, embedding, language, ngrams
from .functions import text as X
from .functions import vector as V
from .mailview import DAY, DAY_SQL, EFFECTIVE_SQL, MAIL_SQL, accounts, labels, mail, mailboxes, table
from .operators import archive, arms, cells, control, filters, fusion, paging, positions, postings, queue, shapes
from .plans import dsl
from .shared import shared_folder, written
from .streaming import sync

NOW = datetime(2024, 1, 20, 12)
NOW_SQL = "TIMESTAMP '2024-01-20 12:00:00'"
AT = datetime(2024, 1, 10)
PAGE = 50
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_DOC = "' ' || array_to_string(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+'), ' ') || ' '".format
_MAIL_TEXT = "concat_ws(' ', coalesce(subject, ''), coalesce(from_addr, ''), coalesce(from_name, ''), coalesce(body_text, ''), array_to_string(to_addrs, ' '))"
_SHOWN = f"strftime({EFFECTIVE_SQL}, '{DAY_SQL}')"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _shown() -> Column:
    return F.date_format("effective_date", DAY).alias("shown_date")


def _mail(rest: str) -> str:
    return f"WITH {MAIL_SQL} {rest}"


def _search(spark: SparkSession, sf_dir: str, text: str, allowed=None) -> DataFrame:
    """Messages that a query's filters and its words leave."""
    q, m = dsl.parse(text), mail(spark, sf_dir)
    found = filters.apply_filters(m, q, accounts(spark), labels(m), mailboxes(m), allowed)
    tree = dsl.match_tree(q.free_text)
    return found if tree is None else found.filter(filters.text_match(tree, found))


# Date walks.


@query(_mail(f"SELECT message_id, {_SHOWN} AS shown_date, body_lang FROM mail WHERE body_lang = 'de' AND date_sent >= TIMESTAMP '2024-01-02' ORDER BY {EFFECTIVE_SQL} DESC NULLS LAST, message_id DESC LIMIT {PAGE + 1}"))
def keyset_first_desc(spark, sf_dir):
    return paging.walk(_search(spark, sf_dir, "lang:de after:2024-01-02"), PAGE).select("message_id", _shown(), "body_lang")


@query(_mail(f"SELECT message_id, {_SHOWN} AS shown_date FROM mail WHERE {EFFECTIVE_SQL} < TIMESTAMP '2024-01-10' OR ({EFFECTIVE_SQL} = TIMESTAMP '2024-01-10' AND message_id < 300) OR {EFFECTIVE_SQL} IS NULL ORDER BY {EFFECTIVE_SQL} DESC NULLS LAST, message_id DESC LIMIT {PAGE + 1}"))
def keyset_next_desc(spark, sf_dir):
    return paging.walk(mail(spark, sf_dir), PAGE, "desc", paging.Cursor(AT, 300)).select("message_id", _shown())


@query(_mail(f"SELECT message_id, {_SHOWN} AS shown_date FROM mail ORDER BY {EFFECTIVE_SQL} ASC NULLS FIRST, message_id LIMIT {PAGE + 1}"))
def keyset_first_asc(spark, sf_dir):
    return paging.walk(mail(spark, sf_dir), PAGE, "asc").select("message_id", _shown())


@query(_mail(f"SELECT message_id, {_SHOWN} AS shown_date FROM mail WHERE ({EFFECTIVE_SQL} IS NULL AND message_id > 100) OR {EFFECTIVE_SQL} IS NOT NULL ORDER BY {EFFECTIVE_SQL} ASC NULLS FIRST, message_id LIMIT {PAGE + 1}"))
def keyset_next_asc(spark, sf_dir):
    return paging.walk(mail(spark, sf_dir), PAGE, "asc", paging.Cursor(None, 100, "asc")).select("message_id", _shown())


@query(_mail(f"SELECT message_id, {_SHOWN} AS shown_date FROM mail WHERE {EFFECTIVE_SQL} IS NULL AND message_id < 180 ORDER BY message_id DESC LIMIT {PAGE + 1}"))
def keyset_undated_tail(spark, sf_dir):
    return paging.walk(mail(spark, sf_dir), PAGE, "desc", paging.Cursor(None, 180)).select("message_id", _shown())


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 40)
  AND (o_orderdate < TIMESTAMP '1997-01-01' OR (o_orderdate = TIMESTAMP '1997-01-01' AND o_orderkey < 1000) OR o_orderdate IS NULL)
ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 51""")
def browse_folder_semi(spark, sf_dir):
    folder = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = table(spark, sf_dir, "orders").join(folder, "o_orderkey", "left_semi")
    cursor = paging.Cursor(datetime(1997, 1, 1), 1000)
    return paging.walk(rows, PAGE, "desc", cursor, "o_orderdate", "o_orderkey").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


# Filters.


@query(_mail("SELECT message_id FROM mail WHERE (from_addr ILIKE '%click%' OR from_name ILIKE '%click%') AND subject ILIKE '%the%' AND body_lang IN ('en', 'de')"))
def filter_from_subject_lang(spark, sf_dir):
    return _search(spark, sf_dir, "from:click subject:the lang:en lang:DE").select("message_id")


@query(_mail("SELECT message_id FROM mail WHERE len(list_filter(to_addrs, lambda t: t ILIKE '%user1%@EXAMPLE%')) > 0"))
def filter_to_array(spark, sf_dir):
    return _search(spark, sf_dir, "to:user1%@EXAMPLE").select("message_id")


@query(_mail("SELECT message_id FROM mail WHERE date_sent >= TIMESTAMP '2024-01-02' AND date_sent < TIMESTAMP '2024-01-09'"))
def filter_dates_nulls(spark, sf_dir):
    return _search(spark, sf_dir, "after:2024-01-02 before:2024-01-09").select("message_id")


@query(_mail("SELECT message_id FROM mail WHERE 'Box/' || folder ILIKE 'box/SRC1_'"))
def filter_label_ilike(spark, sf_dir):
    return _search(spark, sf_dir, "label:box/SRC1_").select("message_id")


@query(_mail("SELECT message_id FROM mail WHERE folder IN ('src3', 'src4') AND mailbox_id IN (4, 5)"))
def filter_folders(spark, sf_dir):
    return _search(spark, sf_dir, "folder:Box/src3 folder:Box/src4 folder_id:4 folder_id:5").select("message_id")


@query(_mail("SELECT message_id FROM mail WHERE account_id IN (1, 2) AND account_id IN (2, 3)"))
def filter_accounts(spark, sf_dir):
    return _search(spark, sf_dir, "account:acct1 account:acct2 account:nobody account_id:2 account_id:3").select("message_id")


@query(_mail("SELECT message_id FROM mail WHERE len(list_filter(names, lambda n: contains(lower(n), '%_d'))) > 0"))
def filter_attachment_name(spark, sf_dir):
    return _search(spark, sf_dir, 'attachment_name:"%_D"').select("message_id")


@query(_mail("SELECT message_id FROM mail WHERE NOT coalesce(len(names) > 0, FALSE)"))
def filter_has_no_attachment(spark, sf_dir):
    return _search(spark, sf_dir, "has:no-attachment").select("message_id")


@query(_mail("SELECT message_id FROM mail WHERE FALSE"))
def acl_clamp_empty(spark, sf_dir):
    return _search(spark, sf_dir, "lang:de", allowed=[]).select("message_id")


@query(_mail("SELECT message_id, account_id FROM mail WHERE account_id = 3"))
def acl_clamp_some(spark, sf_dir):
    ids = filters.clamp_accounts([1, 3], [3, 4])
    return mail(spark, sf_dir).filter(filters.in_accounts(ids)).select("message_id", "account_id")


# Full text.


def _docs(spark, sf_dir, text):
    tree = dsl.match_tree(text)
    return table(spark, sf_dir, "documents").filter(X.may_match(tree, F.lower("text")) & X.matches(tree, X.document(F.col("text")))).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, {_DOC('text')} AS d FROM documents) WHERE (contains(d, ' the ') AND contains(d, ' with ') AND NOT contains(d, ' from ')) OR contains(d, ' nicht ')")
def fts_match_and_or_not(spark, sf_dir):
    return _docs(spark, sf_dir, "the WITH -from OR nicht")


@query(f"SELECT doc_id FROM (SELECT doc_id, {_DOC('text')} AS d FROM documents) WHERE contains(d, ' of the ') AND contains(d, ' and ')")
def fts_phrase(spark, sf_dir):
    return _docs(spark, sf_dir, '"of the" and')


@query("""SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id DESC) AS rank FROM (
  SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: w IN ('the', 'on'))) AS DOUBLE) AS score, """ + _DOC("text") + """ AS d FROM documents)
WHERE contains(d, ' the ') AND contains(d, ' on ') ORDER BY score DESC, doc_id DESC LIMIT 50""")
def fts_rank_tf(spark, sf_dir):
    m = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id"), "text")
    tree = dsl.match_tree("the on")
    doc = X.document(F.col("text"))
    likely = m.filter(X.may_match(tree, F.lower("text")))
    scored = likely.select("message_id", F.lit(None).cast("long").alias("chunk_id"), F.lit("messages").alias("chunk_table"), F.when(X.matches(tree, doc), arms.tf_score(tree, doc)).alias("arm_score"))
    return arms.top_ranked(scored, 50, 1).select(F.col("message_id").alias("doc_id"), F.col("arm_score").alias("score"), F.col("rank").cast("long"))


@query(_mail(f"SELECT message_id FROM (SELECT message_id, {_DOC(_MAIL_TEXT)} AS d, {_DOC(chr(34) + 'nm' + chr(34))} AS n FROM (SELECT *, coalesce(array_to_string(list_transform(names, lambda x: x || ' ' || regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+|_', ' ', 'g')), ' '), '') AS nm FROM mail)) WHERE (contains(d, ' the ') OR contains(n, ' the ')) AND NOT contains(d, ' photo ') AND NOT contains(n, ' photo ')"))
def fts_exclusion_message_level(spark, sf_dir):
    return _search(spark, sf_dir, "the -photo").select("message_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, {_DOC('text')} AS d FROM documents) WHERE contains(d, ' nichtwort ') OR (contains(d, ' with ') AND contains(d, ' by ')) OR contains(d, ' sich ')")
def fts_expansion_or(spark, sf_dir):
    tree = dsl.expanded_tree(dsl.Query("nichtwort", expansions=("with by", "sich")))
    return table(spark, sf_dir, "documents").filter(X.may_match(tree, F.lower("text")) & X.matches(tree, X.document(F.col("text")))).select("doc_id")


@query(_mail("SELECT message_id FROM mail WHERE len(list_filter(names, lambda n: contains(' ' || array_to_string(regexp_extract_all(lower(n), '[\\p{L}\\p{N}]+'), ' ') || ' ', ' done '))) > 0"))
def fts_attachment_names(spark, sf_dir):
    return _search(spark, sf_dir, "done").select("message_id")


@query(_mail(f"SELECT message_id FROM (SELECT message_id, {_DOC(_MAIL_TEXT)} AS d FROM mail) WHERE (contains(d, ' the ') AND contains(d, ' of the ') AND NOT contains(d, ' from ')) OR (contains(d, ' nicht ') AND contains(d, ' der '))"))
def fts_postings(spark, sf_dir):
    tree, m = dsl.match_tree('the "of the" -from OR nicht der'), mail(spark, sf_dir)
    likely = postings.candidates(postings.build(m), tree)
    return m.join(likely, "message_id", "left_semi").filter(X.matches(tree, filters.message_document(m))).select("message_id")


def _cover_sql(words: str, terms: list[str], name: str) -> str:
    """CTEs that end in ``name`` (message_id, s): the cover density of (message_id, part, pos, word, inv) by its parts, summed."""
    last = ", ".join(f"max(CASE WHEN word = '{t}' THEN i END) OVER (PARTITION BY message_id, part ORDER BY i) AS l{k}" for k, t in enumerate(terms))
    seen = " AND ".join(f"l{k} IS NOT NULL" for k in range(len(terms)))
    return f"""{name}_p AS (SELECT *, row_number() OVER (PARTITION BY message_id, part ORDER BY pos) AS i FROM {words} WHERE word IN ({", ".join(f"'{t}'" for t in terms)})),
{name}_c AS (SELECT *, sum(inv) OVER (PARTITION BY message_id, part ORDER BY i) AS upto, {last} FROM {name}_p),
{name}_s AS (SELECT *, CASE WHEN {seen} THEN least({", ".join(f"l{k}" for k in range(len(terms)))}) END AS start FROM {name}_c),
{name}_n AS (SELECT *, coalesce(lag(start) OVER (PARTITION BY message_id, part ORDER BY i), 0) AS earlier FROM {name}_s),
{name} AS (SELECT n.message_id, sum((n.i - c.i + 1) / (n.upto - c.upto + c.inv) / (1 + n.pos - c.pos - (n.i - c.i))) AS s
  FROM {name}_n n JOIN {name}_c c ON c.message_id = n.message_id AND c.part = n.part AND c.i = n.start WHERE n.start > n.earlier GROUP BY 1)"""


_WORDS_OF = "list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: {{'word': x, 'inv': {1}e0}})".format
_PLACED = "(SELECT message_id, part, unnest(w, max_depth := 2), unnest(generate_series(1, len(w))) AS pos FROM ({0}))".format
# Words of messages by weight (subject 1, sender 2/3, body 1/3, recipients 1/6), and of attachment names at the subject's.
_WEIGHTED = " || ".join(
    (_WORDS_OF("coalesce(subject, '')", 1), _WORDS_OF("concat_ws(' ', from_addr, from_name)", 1.5), _WORDS_OF("coalesce(body_text, '')", 3), _WORDS_OF("array_to_string(to_addrs, ' ')", 6))
)
_NAMES = "coalesce(array_to_string(names, ' '), '')"
_MESSAGE_WORDS = _PLACED(f"SELECT message_id, 0 AS part, {_WEIGHTED} AS w FROM mail UNION ALL SELECT message_id, 1, {_WORDS_OF(_NAMES, 1)} FROM mail")
_SPLIT_NAMES = "coalesce(array_to_string(list_transform(names, lambda x: x || ' ' || regexp_replace(x, '[^\\p{L}\\p{N}]+|_', ' ', 'g')), ' '), '')"
_MATCHED = f"SELECT *, {_DOC(_MAIL_TEXT)} AS d, {_DOC('nm')} AS n FROM (SELECT *, {_SPLIT_NAMES} AS nm FROM mail)"


@query(_mail(f""", {_cover_sql(_MESSAGE_WORDS, ["of", "the", "with"], "density")}
SELECT message_id, round(s, 6) AS score, CAST(row_number() OVER (ORDER BY s DESC, message_id DESC) AS INTEGER) AS rank
FROM (SELECT message_id, round(s, 9) AS s FROM density JOIN ({_MATCHED}) USING (message_id)
  WHERE (contains(d, ' of the ') AND contains(d, ' with ')) OR (contains(n, ' of the ') AND contains(n, ' with ')) ORDER BY s DESC, message_id DESC LIMIT 50)"""))
def fts_cover_density(spark, sf_dir):
    q = dsl.parse('"of the" with')
    return arms.message_text_arm(mail(spark, sf_dir), q, 50, cover_density=True).select("message_id", F.round("arm_score", 6).alias("score"), "rank")


def _indexed(spark, sf_dir) -> positions.Index:
    """All messages, indexed in the shared folder; what searches read from there on is the index alone."""
    path = shared_folder(spark, "positions")
    positions.write(mail(spark, sf_dir), path, 64)
    return positions.read(spark, path, 64)


@query(_mail(f"SELECT message_id FROM ({_MATCHED}) WHERE ((contains(d, ' of the ') AND contains(d, ' and ')) OR (contains(d, ' nicht ') AND NOT contains(d, ' der ')) OR contains(d, ' report ')) OR ((contains(n, ' of the ') AND contains(n, ' and ')) OR (contains(n, ' nicht ') AND NOT contains(n, ' der ')) OR contains(n, ' report '))"))
def fts_index_phrase(spark, sf_dir):
    return positions.matching(_indexed(spark, sf_dir), dsl.match_tree('"of the" and OR nicht -der OR report'))


@query(_mail(f"SELECT message_id FROM ({_MATCHED}) WHERE NOT contains(d, ' the ')"))
def fts_index_exclusion(spark, sf_dir):
    return positions.matching(_indexed(spark, sf_dir), dsl.match_tree("-the"))


@query(_mail(f""", {_cover_sql(_MESSAGE_WORDS, ["with", "by"], "one")}, {_cover_sql(_MESSAGE_WORDS, ["sich", "der", "und"], "two")},
scored AS (SELECT message_id, round(coalesce(one.s, 0) + coalesce(two.s, 0), 9) AS s FROM ({_MATCHED}) LEFT JOIN one USING (message_id) LEFT JOIN two USING (message_id)
  WHERE (contains(d, ' with ') AND contains(d, ' by ')) OR (contains(d, ' sich ') AND contains(d, ' der und ')) OR (contains(n, ' with ') AND contains(n, ' by ')))
SELECT message_id, round(s, 6) AS score, CAST(row_number() OVER (ORDER BY s DESC, message_id DESC) AS INTEGER) AS rank FROM scored ORDER BY s DESC, message_id DESC LIMIT 50"""))
def fts_index_ranked(spark, sf_dir):
    """Top 50 of two alternatives, one with a phrase, by early stop over the index."""
    found = arms.indexed_text_arm(_indexed(spark, sf_dir), None, dsl.parse('with by OR sich "der und"'), 50)
    return found.select("message_id", F.round("arm_score", 6).alias("score"), "rank")


# Vectors.

_VECTOR = [((i * 7) % 13 - 6) / 6 for i in range(64)]
_VECTOR_SQL = "[" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in _VECTOR) + "]"
_COS = f"round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {_VECTOR_SQL}), 6)"


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("message_id"), "embedding", "label")


def _near(arm: DataFrame) -> DataFrame:
    return arm.select("message_id", F.round("arm_score", 6).alias("score"))


@query(f"SELECT vec_id AS message_id, {_COS} AS score FROM embeddings ORDER BY list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {_VECTOR_SQL}) DESC, vec_id DESC LIMIT 50")
def vector_knn(spark, sf_dir):
    return _near(arms.chunk_vector_arm(_chunks(spark, sf_dir), None, _VECTOR, 50))


@query(_mail(f"SELECT message_id, {_COS} AS score FROM mail JOIN embeddings ON vec_id = message_id WHERE body_lang = 'en' AND account_id IN (1, 2) ORDER BY 2 DESC, 1 DESC LIMIT 20"))
def vector_knn_filtered(spark, sf_dir):
    return _near(arms.chunk_vector_arm(_chunks(spark, sf_dir), _search(spark, sf_dir, "lang:en account_id:1 account_id:2"), _VECTOR, 20))


def _cells(spark, sf_dir) -> cells.Cells:
    """The vectors of all embeddings by cell, as many cells as the square root of their number."""
    rows = _chunks(spark, sf_dir)
    return cells.build(rows, shared_folder(spark, "cells"), max(1, math.isqrt(rows.count())))


@query(f"SELECT vec_id AS message_id, {_COS} AS score FROM embeddings ORDER BY round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {_VECTOR_SQL}), 9) DESC, vec_id DESC LIMIT 50")
def vector_cells_exact(spark, sf_dir):
    """The exact search of the index by cells: those whose bound is too low are not read."""
    return _near(arms.indexed_vector_arm(_cells(spark, sf_dir), None, _VECTOR, 50, None))


@query(_mail(f"SELECT message_id, {_COS} AS score FROM mail JOIN embeddings ON vec_id = message_id WHERE body_lang = 'en' ORDER BY round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {_VECTOR_SQL}), 9) DESC, vec_id DESC LIMIT 20"))
def vector_cells_filtered(spark, sf_dir):
    return _near(arms.indexed_vector_arm(_cells(spark, sf_dir), _search(spark, sf_dir, "lang:en"), _VECTOR, 20, None))


@query("""WITH q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, count(*) AS n, TRUE AS reached FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), v), 9) DESC, vec_id DESC) AS r FROM q, embeddings) WHERE r <= 50 GROUP BY 1""")
def vector_cells_recall(spark, sf_dir):
    """Every fiftieth vector asks for its 50 nearest of all: whether the mean recall of the probed cells, against all cells, is 0.9 or more."""
    index = _cells(spark, sf_dir)
    asked = _chunks(spark, sf_dir).filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    truth = written(cells.search_many(spark, index, asked, 50, len(index.centroids)))
    found = cells.search_many(spark, index, asked, 50, max(1, len(index.centroids) * 4 // 5))
    mean = cells.recall(found, truth).agg((F.avg("recall") >= 0.9).alias("reached"))
    return truth.groupBy("query_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(mean))


_FANOUT = f"""near AS (SELECT vec_id AS chunk_id, label, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {_VECTOR_SQL}), 9) AS s FROM embeddings ORDER BY s DESC, vec_id DESC LIMIT 150),
carried AS (SELECT chunk_id, message_id, s, row_number() OVER (PARTITION BY chunk_id ORDER BY date_sent DESC NULLS LAST, message_id DESC) AS nth FROM near JOIN mail ON message_id % 10 = label WHERE body_lang = 'en')"""


@query(_mail(f", {_FANOUT} SELECT chunk_id, message_id, round(s, 6) AS score FROM carried WHERE nth <= 10 ORDER BY s DESC, message_id DESC, chunk_id DESC LIMIT 50"))
def vector_attachment_fanout(spark, sf_dir):
    chunks = _chunks(spark, sf_dir).select("chunk_id", "embedding", F.col("label").cast("string").alias("sha256"))
    carriers = _search(spark, sf_dir, "lang:en").select("message_id", (F.col("message_id") % 10).cast("string").alias("sha256"), "date_sent")
    return arms.attachment_vector_arm(chunks, carriers, _VECTOR, 50).select("chunk_id", "message_id", F.round("arm_score", 6).alias("score"))


# Fusion, pools and hydration.


def _arms(spark, sf_dir) -> list[DataFrame]:
    m = mail(spark, sf_dir)
    chunks = _chunks(spark, sf_dir)
    with_text = chunks.join(m.select("message_id", F.col("body_text").alias("text")), "message_id")
    q = dsl.parse("the on")
    return [arms.message_text_arm(m, q, 50), arms.chunk_text_arm(with_text, m, q, 50), arms.chunk_vector_arm(chunks, m, _VECTOR, 50)]


_TF = "CAST(len(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ('the', 'on'))) AS DOUBLE)".format
_ARMS_SQL = f"""
docs AS (SELECT *, {_DOC(_MAIL_TEXT)} AS d, {_DOC('body_text')} AS b FROM mail),
a1 AS (SELECT message_id, CAST(NULL AS BIGINT) AS chunk_id, s, row_number() OVER (ORDER BY s DESC, message_id DESC) AS rank, 1 AS arm FROM (SELECT message_id, {_TF(_MAIL_TEXT)} AS s FROM docs WHERE contains(d, ' the ') AND contains(d, ' on ') ORDER BY s DESC, message_id DESC LIMIT 50)),
a2 AS (SELECT message_id, message_id AS chunk_id, s, row_number() OVER (ORDER BY s DESC, message_id DESC) AS rank, 2 AS arm FROM (SELECT message_id, {_TF('body_text')} AS s FROM docs JOIN embeddings ON vec_id = message_id WHERE contains(b, ' the ') AND contains(b, ' on ') ORDER BY s DESC, message_id DESC LIMIT 50)),
a3 AS (SELECT message_id, message_id AS chunk_id, s, row_number() OVER (ORDER BY s DESC, message_id DESC) AS rank, 3 AS arm FROM (SELECT message_id, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {_VECTOR_SQL}), 9) AS s FROM mail JOIN embeddings ON vec_id = message_id ORDER BY s DESC, message_id DESC LIMIT 50)),
hits AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3),
fused AS (SELECT message_id, round(sum(1e0 / (60 + rank)), 12) AS rrf, list_sort(list_distinct(list(arm))) AS arms FROM hits GROUP BY message_id)"""


@query(_mail(f", {_ARMS_SQL} SELECT message_id, round(rrf, 9) AS score, array_to_string(arms, ',') AS arms FROM fused ORDER BY rrf DESC, message_id DESC LIMIT 20"))
def rrf_hybrid(spark, sf_dir):
    fused = fusion.fuse(_arms(spark, sf_dir))
    top = fused.orderBy(F.desc("rrf_score"), F.desc("message_id")).limit(20)
    return top.select("message_id", F.round("rrf_score", 9).alias("score"), F.array_join(F.col("contributing_arms").cast("array<string>"), ",").alias("arms"))


_BODY_WORDS = _PLACED(f"SELECT message_id, 0 AS part, {_WORDS_OF('body_text', 10)} AS w FROM mail SEMI JOIN embeddings ON vec_id = message_id")
_RANKED_SQL = f"""{_cover_sql(_MESSAGE_WORDS, ["the", "on"], "in_mail")}, {_cover_sql(_BODY_WORDS, ["the", "on"], "in_chunk")},
docs AS ({_MATCHED}),
r1 AS (SELECT message_id, row_number() OVER (ORDER BY s DESC, message_id DESC) AS rank, 1 AS arm FROM (SELECT message_id, round(s, 9) AS s FROM in_mail JOIN docs USING (message_id)
  WHERE (contains(d, ' the ') AND contains(d, ' on ')) OR (contains(n, ' the ') AND contains(n, ' on ')) ORDER BY s DESC, message_id DESC LIMIT 50)),
r2 AS (SELECT message_id, row_number() OVER (ORDER BY s DESC, message_id DESC) AS rank, 2 AS arm FROM (SELECT message_id, round(s, 9) AS s FROM in_chunk ORDER BY s DESC, message_id DESC LIMIT 50))"""


@query(_mail(f", {_RANKED_SQL} SELECT message_id, round(sum(1e0 / (60 + rank)), 9) AS score, array_to_string(list_sort(list(arm)), ',') AS arms FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY 1"))
def rrf_cover_density(spark, sf_dir):
    """Both text arms ranked as searches rank them."""
    m, q = mail(spark, sf_dir), dsl.parse("the on")
    with_text = _chunks(spark, sf_dir).join(m.select("message_id", F.col("body_text").alias("text")), "message_id")
    fused = fusion.fuse([arms.message_text_arm(m, q, 50, cover_density=True), arms.chunk_text_arm(with_text, m, q, 50, cover_density=True)])
    return fused.select("message_id", F.round("rrf_score", 9).alias("score"), F.array_join(F.col("contributing_arms").cast("array<string>"), ",").alias("arms"))


@query(_mail(f", {_ARMS_SQL} SELECT message_id, arg_min(chunk_id, (rank, arm)) FILTER (chunk_id IS NOT NULL) AS best_chunk_id FROM hits GROUP BY 1"))
def rrf_best_chunk(spark, sf_dir):
    return fusion.fuse(_arms(spark, sf_dir)).select("message_id", "best_chunk_id")


@query(_mail(f", {_ARMS_SQL} SELECT message_id, {_SHOWN} AS shown_date FROM (SELECT message_id, round(rrf, 2) AS r FROM fused) JOIN mail USING (message_id) ORDER BY r DESC, {EFFECTIVE_SQL} DESC NULLS LAST, message_id DESC LIMIT 30"))
def pool_cut_ties(spark, sf_dir):
    coarse = fusion.fuse(_arms(spark, sf_dir)).withColumn("rrf_score", F.round("rrf_score", 2))
    return fusion.cut_pool(coarse, mail(spark, sf_dir), 30).select("message_id", _shown())


@query(_mail(f", {_ARMS_SQL} SELECT message_id FROM fused ORDER BY rrf DESC, message_id DESC OFFSET 20"))
def pool_grow_exclude(spark, sf_dir):
    fused = fusion.fuse(_arms(spark, sf_dir))
    served = fused.orderBy(F.desc("rrf_score"), F.desc("message_id")).limit(20)
    return fusion.without_served(fused, served).select("message_id")


@query(_mail(f""", {_ARMS_SQL} SELECT message_id, place - 10 AS rank FROM (SELECT message_id, row_number() OVER (ORDER BY rrf DESC, message_id DESC) AS place FROM fused) WHERE place > 10 AND place <= 20"""))
def pool_page_two(spark, sf_dir):
    page = fusion.paged(fusion.fuse(_arms(spark, sf_dir)), [F.desc("rrf_score"), F.desc("message_id")], 2, 10)
    return page.select("message_id", F.col("rank").cast("long"))


@query(f"""SELECT doc_id, CASE WHEN length(text) <= 120 THEN text
  WHEN p > 0 THEN CASE WHEN s > 0 THEN '…' ELSE '' END || substr(text, s + 1, 120) || CASE WHEN s + 120 < length(text) THEN '…' ELSE '' END
  ELSE regexp_replace(substr(text, 1, 120), '\\s+\\S*$', '') || '…' END AS snippet
FROM (SELECT *, greatest(p - 1 - 60, 0) AS s FROM (SELECT doc_id, text, least(nullif(instr(lower(text), 'nicht'), 0), nullif(instr(lower(text), 'with'), 0)) AS p FROM documents))""")
def hydrate_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), ["nicht", "with"], 120).alias("snippet"))


# Accounts, folders, status.


@query(_mail(f"SELECT a.id AS account_id, count(message_id) AS n_messages, strftime(max({EFFECTIVE_SQL}), '{DAY_SQL}') AS last_sync, coalesce(max({EFFECTIVE_SQL}) < {NOW_SQL} - INTERVAL 30 DAY, TRUE) AS stale FROM (SELECT unnest(generate_series(0, 5)) AS id) a LEFT JOIN mail ON account_id = a.id GROUP BY 1"))
def account_stats(spark, sf_dir):
    m = mail(spark, sf_dir)
    boxes = m.groupBy("account_id").agg(F.max("effective_date").alias("last_sync_at"))
    return archive.account_stats(accounts(spark), m, boxes, NOW).select("account_id", "n_messages", F.date_format("last_sync_at", DAY).alias("last_sync"), "stale")


@query(_mail("SELECT mailbox_id, 'Box/' || folder AS name, count(*) AS n_messages FROM mail GROUP BY ALL"))
def folder_counts(spark, sf_dir):
    m = mail(spark, sf_dir)
    return archive.folder_counts(mailboxes(m), labels(m)).select("mailbox_id", "name", "n_messages")


@query("SELECT count(*) AS n_messages, count(label) AS n_embedded, count(*) FILTER (lang IS NOT NULL) AS n_lang, count(*) FILTER (n_chars < 20) AS n_declined FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def status_totals(spark, sf_dir):
    messages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id"), F.col("lang").alias("body_lang"), "n_chars")
    return archive.status_totals(messages, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("message_id")))


_BUCKETS = {"extracted": "quality = 1 AND toxic = 0", "no_text": "quality = 0 AND toxic = 0", "gave_up": "toxic = 1", "pending": "quality IS NULL"}
_JOINED = "documents LEFT JOIN labels USING (doc_id)"


def _queue(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("SELECT count(*) AS eligible, " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _BUCKETS.items()) + f" FROM {_JOINED}")
def queue_partition(spark, sf_dir):
    buckets = {n: F.coalesce(F.expr(c), F.lit(False)) for n, c in _BUCKETS.items()}
    return archive.partition_counts(_queue(spark, sf_dir), buckets).drop("misfiled")


@query(f"SELECT count(*) AS eligible, count(*) FILTER ((CAST(quality = 1 AS INT) + CAST(toxic = 1 AS INT)) IS DISTINCT FROM 1) AS misfiled FROM {_JOINED}")
def queue_misfiled(spark, sf_dir):
    return archive.partition_counts(_queue(spark, sf_dir), {"a": F.expr("quality = 1"), "b": F.expr("toxic = 1")}).select("eligible", "misfiled")


@query(f"SELECT count(*) FILTER (event_type = 'click' AND ts > {NOW_SQL} - INTERVAL 3600 SECOND) AS n_hour, count(*) FILTER (user_id = 1 AND ts > {NOW_SQL} - INTERVAL 86400 SECOND) AS n_day, count(*) FILTER (ts > {NOW_SQL} - INTERVAL 604800 SECOND) AS n_week FROM events")
def rate_limit_windows(spark, sf_dir):
    return archive.windowed_counts(table(spark, sf_dir, "events"), "ts", NOW, {"n_hour": (F.expr("event_type = 'click'"), 3600), "n_day": (F.expr("user_id = 1"), 86400), "n_week": (F.lit(True), 604800)})


@query("SELECT e.user_id, count(*) FILTER (event_type <> 'purchase' AND (l IS NULL OR ts > l)) AS failures FROM events e JOIN (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS l FROM events GROUP BY 1) x ON x.user_id = e.user_id GROUP BY 1")
def failures_since_success(spark, sf_dir):
    return archive.failures_since_success(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "purchase")


@query("SELECT c_nationkey, coalesce(array_to_string(list_sort(list(DISTINCT c_mktsegment) FILTER (c_acctbal > 0)), ','), '') AS segments FROM customer GROUP BY 1")
def keys_array_agg(spark, sf_dir):
    named = archive.names_by_key(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", F.col("c_acctbal") > 0)
    return named.select("c_nationkey", F.array_join("names", ",").alias("segments"))


@query(f"SELECT user_id, event_type, count(*) AS retry_count, arg_max(props, (ts, props)) AS last_error, strftime(max(ts), '{DAY_SQL}') AS last_day FROM events GROUP BY 1, 2")
def failure_retry_rollup(spark, sf_dir):
    return archive.retry_ledger(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "props").withColumn("last_at", F.date_format("last_at", DAY)).withColumnRenamed("last_at", "last_day")


# Joins and queues.


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def unchunked_anti(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return archive.without_derived(table(spark, sf_dir, "documents").select("doc_id"), chunks, "doc_id")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 5)")
def under_retry_cap_anti(spark, sf_dir):
    failures = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"))
    return archive.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), failures, "doc_id", 5).select("doc_id").distinct()


@query(_mail("SELECT message_id, unnest(generate_series(0, CAST(len(names) AS INT) - 1)) AS position, unnest(names) AS filename FROM mail WHERE len(names) > 0"))
def lateral_attachments_ordinality(spark, sf_dir):
    return shapes.attachment_list(mail(spark, sf_dir)).select("message_id", F.col("position").cast("long").alias("position"), "filename")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def left_join_on_residual(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return archive.left_joined(c, o, "c_custkey", "o_custkey", F.col("o_orderstatus") == "P").select("c_custkey", "o_orderkey")


# Events as a queue's log: blobs are users, and each kind of event an outcome; a view is a claim, and some errors open a blob again.

_KIND = "CASE event_type WHEN 'view' THEN 'claim' WHEN 'purchase' THEN CASE WHEN event_id % 40 = 0 THEN 'text' WHEN event_id % 40 = 1 THEN 'empty' ELSE 'poison' END WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'reset' ELSE 'transient' END WHEN 'click' THEN 'transient' ELSE 'claim' END"
_STATES_SQL = f"""log AS (SELECT 'b' || user_id AS sha256, date_trunc('minute', ts) AS t, {_KIND} AS kind FROM events),
marks AS (SELECT sha256, max(t) FILTER (kind = 'reset') AS reset_at, max(t) FILTER (kind IN ('text', 'empty')) AS done_at, max(t) FILTER (kind = 'claim') AS claim_at, max(t) FILTER (kind <> 'claim') AS settled_at, arg_max(kind, (t, kind)) FILTER (kind IN ('text', 'empty')) AS done FROM log GROUP BY 1),
fails AS (SELECT sha256, count(*) FILTER (kind = 'poison') AS p, count(*) FILTER (kind = 'transient' AND (done_at IS NULL OR t > done_at)) AS x, max(t) FILTER (kind = 'transient' AND (done_at IS NULL OR t > done_at)) AS transient_at
  FROM log JOIN marks USING (sha256) WHERE kind IN ('poison', 'transient') AND (reset_at IS NULL OR t > reset_at) GROUP BY 1),
blobs AS (SELECT 'b' || c_custkey AS sha256, c_custkey % 97 AS first_seen_at, c_mktsegment FROM customer),
rows AS (SELECT sha256, first_seen_at, c_mktsegment, done, coalesce(p, 0) AS p, coalesce(x, 0) AS x, transient_at, CASE WHEN settled_at IS NULL OR claim_at > settled_at THEN claim_at END AS claimed_at FROM blobs LEFT JOIN marks USING (sha256) LEFT JOIN fails USING (sha256))"""
_UNDER = "p < 3 AND x < 5"


def _work(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    log = table(spark, sf_dir, "events").select(F.concat(F.lit("b"), "user_id").alias("sha256"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("at"), F.expr(_KIND).alias("kind"), F.lit(None).cast("string").alias("error"))
    states = written(queue.state(log))
    blobs = table(spark, sf_dir, "customer").select(F.concat(F.lit("b"), "c_custkey").alias("sha256"), (F.col("c_custkey") % 97).alias("first_seen_at"), "c_mktsegment")
    return queue.joined(blobs, *queue.tables(states)), states


@query(f"WITH {_STATES_SQL} SELECT count(*) AS eligible, count(*) FILTER (done = 'text') AS extracted, count(*) FILTER (done = 'empty') AS no_text, count(*) FILTER (done IS NULL AND NOT ({_UNDER})) AS gave_up, count(*) FILTER (done IS NULL AND {_UNDER}) AS pending, 0 AS misfiled FROM rows WHERE c_mktsegment <> 'BUILDING'")
def work_queue_partition(spark, sf_dir):
    """The four buckets of eligible blobs, by the join of blobs with the three tables of what is known of them."""
    rows, _ = _work(spark, sf_dir)
    return queue.counts(rows, F.col("c_mktsegment") != "BUILDING")


@query(f"WITH {_STATES_SQL} SELECT sha256 FROM rows WHERE done IS NULL AND {_UNDER} AND (claimed_at IS NULL OR claimed_at + INTERVAL 43200 SECOND <= {NOW_SQL}) AND (transient_at IS NULL OR transient_at + to_seconds(CAST(3600 * pow(2, greatest(x, 1) - 1) AS BIGINT)) <= {NOW_SQL}) ORDER BY first_seen_at, sha256 LIMIT 100")
def work_queue_claim(spark, sf_dir):
    """The oldest blobs to hand out: within both budgets, not leased for twelve hours, and past their back-off of an hour, doubled each time."""
    rows, states = _work(spark, sf_dir)
    return queue.claimable(rows, states, NOW, 100, 43_200, 3600).select("sha256")


# Change feed, dedup, upserts.

_FEED = f"SELECT event_id FROM events WHERE ts < {NOW_SQL} - INTERVAL 5 SECOND AND user_id % 5 IN (1, 2)"


def _feed(spark, sf_dir, since):
    rows = table(spark, sf_dir, "events").withColumn("account_id", F.col("user_id") % 5)
    return archive.changes(rows, since, NOW, 5, [1, 2], 200, "event_id", "ts").select("event_id")


@query(f"{_FEED} AND event_id > 100 ORDER BY event_id LIMIT 200")
def change_feed_since(spark, sf_dir):
    return _feed(spark, sf_dir, 100)


@query(f"{_FEED} ORDER BY event_id DESC LIMIT 200")
def change_feed_tip(spark, sf_dir):
    return _feed(spark, sf_dir, None)


@query("SELECT user_id, event_type AS name, max(event_id) AS cursor FROM events WHERE event_id <= (SELECT max(doc_id) FROM documents) GROUP BY 1, 2")
def ack_monotonic(spark, sf_dir):
    highest = table(spark, sf_dir, "documents").agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    return archive.acknowledged(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("name"), F.col("event_id").alias("cursor")), highest)


@query("""SELECT user_id, name, cursor FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_at, name) AS n
  FROM (SELECT user_id, strftime(ts, '%d-%H') AS name, max(event_id) AS cursor, min(ts) AS first_at FROM events WHERE event_id <= (SELECT max(event_id) - 100 FROM events) GROUP BY 1, 2)) WHERE n <= 8""")
def subscription_bound(spark, sf_dir):
    """Cursors of each user's first eight subscriptions, of one for each hour of a day."""
    e = table(spark, sf_dir, "events")
    highest = e.agg(F.coalesce(F.max("event_id") - 100, F.lit(0))).first()[0]
    return archive.subscriptions(e.select("user_id", F.date_format("ts", "dd-HH").alias("name"), F.col("event_id").alias("cursor"), "ts"), highest, "ts", 8)


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id)) GROUP BY sha256(text)")
def dedup_first_writer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("key", archive.dedup_key(F.lit(None).cast("string"), F.sha2("text", 256)))
    stored = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("key")
    return archive.insert_if_absent(stored, docs.select("key", "doc_id"), ["key"], [F.col("doc_id")]).select("doc_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def upsert_latest(spark, sf_dir):
    return archive.upsert_latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT mailbox_id, rewind_to FROM (SELECT user_id AS mailbox_id, min(event_id) FILTER (event_type = 'error') AS rewind_to, max(event_id) - 500 AS uidnext FROM events GROUP BY 1) WHERE rewind_to < uidnext")
def uid_rewind_min(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("mailbox_id"), F.col("event_id").alias("uid"), "event_type")
    boxes = e.groupBy("mailbox_id").agg((F.max("uid") - 500).alias("uidnext"))
    return archive.rewind_points(e.filter("event_type = 'error'"), boxes)


@query(f"SELECT user_id AS mailbox_id, event_type AS uid, count(*) AS attempts, strftime(min(ts), '{DAY_SQL}') AS seen, min(ts) <= {NOW_SQL} - INTERVAL 1800 SECOND AS gave_up FROM events GROUP BY 1, 2")
def hold_window_ledger(spark, sf_dir):
    attempts = table(spark, sf_dir, "events").select(F.col("user_id").alias("mailbox_id"), F.col("event_type").alias("uid"), F.col("ts").alias("at"))
    return archive.held_or_given_up(attempts, NOW).select("mailbox_id", "uid", "attempts", F.date_format("first_seen", DAY).alias("seen"), "gave_up")


_OBSERVED = """obs AS (SELECT user_id % 25 AS mailbox_id, date_trunc('day', ts) AS seen_at, CASE WHEN date_trunc('day', ts) >= TIMESTAMP '2024-01-16' AND user_id % 25 % 3 = 0 THEN 2 ELSE 1 END AS uidvalidity,
  epoch_us(ts) // 1000 - 1704067200000 + 1 AS uid, CASE event_type WHEN 'error' THEN 'empty' WHEN 'signup' THEN 'gone' WHEN 'purchase' THEN 'poison' ELSE 'ok' END AS outcome, event_id FROM events),
again AS (SELECT mailbox_id, seen_at + INTERVAL (d) DAY AS seen_at, uid, CASE WHEN d = 1 THEN 'empty' WHEN event_id % 3 = 0 THEN 'ok' WHEN event_id % 3 = 1 THEN 'empty' ELSE 'gone' END AS outcome
  FROM obs, (SELECT unnest([1, 2]) AS d) WHERE outcome = 'empty'),
every AS (SELECT mailbox_id, CAST(seen_at AS TIMESTAMP) AS seen_at, uid, outcome, CASE WHEN seen_at >= TIMESTAMP '2024-01-16' AND mailbox_id % 3 = 0 THEN 2 ELSE 1 END AS epoch FROM (SELECT mailbox_id, seen_at, uid, outcome FROM obs UNION ALL SELECT * FROM again))"""


def _observed(spark, sf_dir) -> DataFrame:
    """Days as passes, with uids by the clock: errors are empty bodies, met again on the two days after."""
    e = table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "error", "empty").when(F.col("event_type") == "signup", "gone").when(F.col("event_type") == "purchase", "poison").otherwise("ok")
    uid = F.expr("unix_millis(CAST(ts AS timestamp)) - 1704067200000 + 1")
    obs = e.select((F.col("user_id") % 25).alias("mailbox_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("at"), uid.alias("uid"), outcome.alias("outcome"), "event_id")
    later = F.when(F.col("d") == 1, "empty").when(F.col("event_id") % 3 == 0, "ok").when(F.col("event_id") % 3 == 1, "empty").otherwise("gone")
    again = obs.filter("outcome = 'empty'").withColumn("d", F.explode(F.array(F.lit(1), F.lit(2)))).withColumns({"outcome": later, "at": F.expr("at + make_dt_interval(d)")}).drop("d")
    every = obs.unionByName(again).drop("event_id")
    validity = F.when((F.col("at") >= F.lit(datetime(2024, 1, 16)).cast("timestamp_ntz")) & (F.col("mailbox_id") % 3 == 0), 2).otherwise(1)
    return every.withColumns({"uidvalidity": validity.cast("long"), "uidnext": F.lit(None).cast("long")})


@query(f"""WITH RECURSIVE {_OBSERVED},
n AS (SELECT *, dense_rank() OVER (PARTITION BY mailbox_id ORDER BY seen_at) AS n, count(*) FILTER (outcome IN ('ok', 'poison')) OVER (PARTITION BY mailbox_id, epoch, uid ORDER BY seen_at) AS outage FROM every),
o AS (SELECT *, outcome = 'empty' AND seen_at - min(CASE WHEN outcome = 'empty' THEN seen_at END) OVER (PARTITION BY mailbox_id, epoch, uid, outage) >= INTERVAL 129600 SECOND AS ended FROM n),
p AS (SELECT mailbox_id, n, epoch, list(uid) FILTER (outcome = 'empty' AND NOT ended) AS held, list(uid) FILTER (outcome <> 'empty' OR ended) AS met FROM o GROUP BY ALL),
s AS (SELECT mailbox_id, n, epoch, CAST(1 AS BIGINT) AS start, held, met FROM p WHERE n = 1
  UNION ALL SELECT p.mailbox_id, p.n, p.epoch, CASE WHEN p.epoch <> s.epoch THEN 1 ELSE least(greatest(start, coalesce(list_max(list_filter(s.met, lambda x: x >= start)) + 1, start)), coalesce(list_min(list_filter(s.held, lambda x: x >= start)), 9e18)) END, p.held, p.met
  FROM s JOIN p ON p.mailbox_id = s.mailbox_id AND p.n = s.n + 1),
f AS (SELECT mailbox_id, epoch, CAST(least(greatest(start, coalesce(list_max(list_filter(met, lambda x: x >= start)) + 1, start)), coalesce(list_min(list_filter(held, lambda x: x >= start)), 9e18)) AS BIGINT) AS uidnext FROM s QUALIFY n = max(n) OVER (PARTITION BY mailbox_id)),
t AS (SELECT o.mailbox_id, o.epoch, uid, outcome, ended FROM o JOIN s USING (mailbox_id, n) WHERE uid >= start),
l AS (SELECT DISTINCT mailbox_id, epoch, uid FROM t WHERE outcome = 'ok'),
g AS (SELECT DISTINCT mailbox_id, epoch, uid FROM t WHERE ended EXCEPT SELECT * FROM l)
SELECT mailbox_id, CAST(epoch AS BIGINT) AS uidvalidity, uidnext, coalesce(a, 0) AS n_labels, coalesce(b, 0) AS n_lost FROM f
LEFT JOIN (SELECT mailbox_id, epoch, count(*) AS a FROM l GROUP BY ALL) USING (mailbox_id, epoch) LEFT JOIN (SELECT mailbox_id, epoch, count(*) AS b FROM g GROUP BY ALL) USING (mailbox_id, epoch)""")
def sync_replay(spark, sf_dir):
    """Each mailbox after all passes: where it starts next, what is labelled, and what is lost."""
    acts = written(sync.replay(_observed(spark, sf_dir), 129_600))
    count = lambda rows, name: rows.groupBy("mailbox_id").agg(F.count("*").alias(name))
    found = sync.watermarks(acts).join(count(sync.labels(acts), "n_labels"), "mailbox_id", "left").join(count(sync.lost(acts), "n_lost"), "mailbox_id", "left")
    return found.fillna(0, ["n_labels", "n_lost"])


# Text derivation.


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - 65, 0), 448)) AS s FROM w WHERE len(w) > 0)
SELECT doc_id, s // 448 AS chunk_idx, array_to_string(w[s + 1:s + 512], ' ') AS text FROM c""")
def chunk_windows(spark, sf_dir):
    cut = X.windows(X.plain_words(F.col("text")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(cut).alias("chunk_idx", "words"))
    return rows.select("doc_id", F.col("chunk_idx").cast("long"), F.array_join("words", " ").alias("text"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace('see ' || url || ' ' || coalesce(html, ''), '(?i)(?:https?://|www\\.)\\S+', ' ', 'g'), '\\s+', ' ', 'g')) AS prepared FROM pages")
def lang_prep(spark, sf_dir):
    text = F.concat(F.lit("see "), F.col("url"), F.lit(" "), F.coalesce("html", F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", X.language_text(text).alias("prepared"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda s: regexp_replace(regexp_replace(s, '[ \\t\\x0b\\f]+', ' ', 'g'), '^ | $', '', 'g')), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS clean FROM documents""")
def whitespace_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_whitespace(F.col("text")).alias("clean"))


@query("SELECT doc_id, substr(text, 101, 50) AS text, length(text) AS total, CASE WHEN length(text) > 150 THEN 150 END AS next_offset FROM documents")
def text_window(spark, sf_dir):
    page = table(spark, sf_dir, "documents").select("doc_id", X.text_window(F.col("text"), 100, 50).alias("w")).select("doc_id", "w.*")
    return page.withColumn("total", F.col("total").cast("long")).withColumn("next_offset", F.col("next_offset").cast("int"))


@query(_mail("SELECT message_id FROM mail WHERE len(list_filter(names, lambda n: lower(regexp_extract(n, '.(\\.[^.]+)$', 1)) IN ('.pdf', '.txt'))) > 0"))
def attachment_ext_allow(spark, sf_dir):
    m = mail(spark, sf_dir)
    return m.filter(X.allowed_type(F.lit("image/png"), filters.attachment_names())).select("message_id")


@query()
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


# Retrieval quality: every benchmark item asks for the documents that hold its first three words.


@query(f"""WITH q AS (SELECT item_id, ' ' || array_to_string((regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))[1:3], ' ') || ' ' AS phrase FROM benchmark),
d AS (SELECT doc_id, lang, {_DOC('text')} AS d FROM documents),
r AS (SELECT item_id AS query_id, lang, doc_id FROM q JOIN d ON contains(d.d, q.phrase)),
h AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id % 7, doc_id) AS rank FROM r),
b AS (SELECT r.query_id, lang, count(h.rank) / count(*) AS recall, coalesce(1 / min(h.rank), 0) AS rr FROM r LEFT JOIN h ON h.query_id = r.query_id AND h.doc_id = r.doc_id AND h.rank <= 20 GROUP BY 1, 2)
SELECT lang, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, count(*) AS n_queries FROM b GROUP BY 1""")
def recall_mrr(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), X.tokens(F.col("text")).alias("w"))
    asked = asked.select("query_id", *[F.get("w", F.lit(i)).alias(f"w{i}") for i in range(3)])
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", X.tokens(F.col("text")).alias("w")).filter(F.size("w") >= 3)
    # Three neighbours each as columns of their own, joined before anything is made distinct.
    triples = F.arrays_zip(*[F.slice("w", i + 1, F.size("w")).alias(f"w{i}") for i in range(3)])
    placed = docs.select("doc_id", "lang", F.explode(triples).alias("t")).select("doc_id", "lang", *[F.col("t")[f"w{i}"].alias(f"w{i}") for i in range(3)])
    relevant = placed.join(asked, ["w0", "w1", "w2"]).select("query_id", "lang", "doc_id").distinct()
    ranked = relevant.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("doc_id") % 7, "doc_id")))
    return archive.retrieval_quality(ranked.select("query_id", "doc_id", "rank"), relevant)


# Documents of any shape, and embedding sweeps.

_JSON = """CASE doc_id % 9 WHEN 0 THEN '[{"filename":"a' || doc_id || '.pdf","sha256":"s' || (doc_id % 50) || '"},{"x":1}]' WHEN 1 THEN '{"filename":"no"}' WHEN 2 THEN '[]' WHEN 3 THEN '"' || lang || '"' WHEN 4 THEN '[1,null,{"filename":' || doc_id || '},{"filename":null}]'
  WHEN 5 THEN '{broken ' || doc_id WHEN 6 THEN NULL WHEN 7 THEN '[{"filename":"b.txt"},{"filename":"c.txt"}' WHEN 8 THEN '[["nested"],{"filename":"' || source || '"}]' END"""


@query(f"""WITH j AS (SELECT doc_id, TRY_CAST({_JSON} AS JSON) AS j FROM documents),
e AS (SELECT doc_id, unnest(generate_series(0, CAST(json_array_length(j) AS BIGINT) - 1)) AS position, j FROM j WHERE json_type(j) = 'ARRAY' AND json_array_length(j) > 0)
SELECT doc_id AS message_id, position, (j->CAST(position AS INTEGER))->>'filename' AS filename, (j->CAST(position AS INTEGER))->>'sha256' AS sha256, json_type(j->CAST(position AS INTEGER)) = 'OBJECT' AS is_object FROM e""")
def json_attachments(spark, sf_dir):
    """Attachments with positions from texts that are arrays, objects, scalars or broken."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id"), F.expr(_JSON).alias("attachments"))
    return documents.attachments(rows).withColumn("position", F.col("position").cast("long"))


@query(f"SELECT doc_id, coalesce(json_type(j) = 'ARRAY' AND json_array_length(j) > 0, FALSE) AS has_attachments, CASE json_type(j) WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'string' END AS kind FROM (SELECT doc_id, TRY_CAST({_JSON} AS JSON) AS j FROM documents)")
def json_kinds(spark, sf_dir):
    text = F.expr(_JSON)
    return table(spark, sf_dir, "documents").select("doc_id", documents.has_attachments(text).alias("has_attachments"), documents.kind(text).alias("kind"))


def _counting_model():
    """A stand-in for a model: how many characters, blanks and letters e a text has."""
    import numpy as np

    return lambda texts: np.array([[len(t), t.count(" "), t.count("e")] for t in texts], np.float32)


@query("SELECT doc_id, CAST(length(text) AS DOUBLE) AS v0, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS v1, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS v2 FROM documents")
def embedding_sweep(spark, sf_dir):
    """Two sweeps, the second only over texts that the first did not have; then all documents with their vectors."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = shared_folder(spark, "vectors")
    for part in (docs.filter("lang = 'en'"), docs):
        old = spark.read.parquet(path) if part is docs else None
        embedding.sweep(part, old, "counts", _counting_model, 3).write.mode("append").parquet(path)
    found = embedding.with_vectors(docs, spark.read.parquet(path), "counts")
    return found.select("doc_id", *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(3)])


# Shapes of answers, derivations and queue reports.


def _quoted(sql: bool):
    """Texts with a reply below, announced in one of five ways by the number of the document, and a signature; and what announces none."""
    heads = ["On Tue, 3 May 2022, Bob Roe wrote:", "Am 3.5.2022 um 10:00 schrieb Bob:", "El mar, 3 may 2022, Bob escribio:", "-----Original Message-----", "On Monday he wrote: fine. And more", "> only quoted lines"]
    if sql:
        cases = " ".join(f"WHEN doc_id % 6 = {i} THEN '{h}'" for i, h in enumerate(heads))
        return f"text || chr(10) || CASE {cases} END || chr(10) || '> old' || chr(10) || 'kept or cut ' || doc_id || chr(10) || '-- ' || chr(10) || 'sig'"
    head = F.lit(heads[0])
    for i, h in enumerate(heads):
        head = F.when(F.col("doc_id") % 6 == i, h).otherwise(head)
    return F.concat("text", F.lit("\n"), head, F.lit("\n> old\nkept or cut "), F.col("doc_id").cast("string"), F.lit("\n-- \nsig"))


_STRIPPED = "regexp_replace(array_to_string(list_filter(string_split(regexp_replace({0}, '(?is)(^|\\n)(?:On [^\\n]+,\\s[^\\n]+\\swrote:|Am [^\\n]+\\sschrieb\\s[^\\n]+:|El [^\\n]+,\\s[^\\n]+\\sescribi[oó]:|-----\\s*Original Message\\s*-----|(?-i:From:[^\\n]+\\nSent:[^\\n]+\\nTo:[^\\n]+))[ \\t\\r\\x0b\\f]*(?:\\n.*)?$', ''), chr(10)), lambda l: NOT regexp_matches(l, '^\\s*>')), chr(10)), '(?s)(^|\\n)-- ?(\\n.*)?$', '')".format


_REPLIED = "(text || chr(10) || '> quoted' || chr(10) || 'On Mon, A wrote:' || chr(10) || '> more' || chr(10) || '-- ' || chr(10) || 'Signature')"


@query(f"SELECT doc_id, {_STRIPPED(_REPLIED)} AS body FROM documents")
def strip_quotes_signature(spark, sf_dir):
    made = F.concat("text", F.lit("\n> quoted\nOn Mon, A wrote:\n> more\n-- \nSignature"))
    return table(spark, sf_dir, "documents").select("doc_id", X.strip_signature(X.strip_quotes(made)).alias("body"))


@query(f"SELECT doc_id, {_STRIPPED(_quoted(True))} AS body FROM documents")
def quoted_replies(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.strip_signature(X.strip_quotes(_quoted(False))).alias("body"))


@query(_mail("SELECT CAST(m.message_id AS VARCHAR) AS message_id, CAST(m.account_id AS VARCHAR) AS account, 'acct' || m.account_id AS account_name, from_addr AS sender, array_to_string(to_addrs, ',') AS receivers, strftime(coalesce(internal_date, date_sent), '%Y-%m-%dT%H:%M:%S') AS date, coalesce(len(names) > 0, FALSE) AS has_attachments FROM mail m"))
def api_hit_shape(spark, sf_dir):
    m = mail(spark, sf_dir)
    hits = m.select("message_id", F.lit(1.0).alias("score"), F.lit("").alias("snippet"), F.array().cast("array<string>").alias("matched_arms"))
    found = shapes.api_hits(hits, m, accounts(spark))
    return found.select("message_id", F.col("account.id").alias("account"), F.col("account.name").alias("account_name"), F.col("from.address").alias("sender"), F.array_join("to", ",").alias("receivers"), "date", "has_attachments")


_BLOBS_SQL = "blobs AS (SELECT sha256(names[1]) AS sha256, 'application/pdf' AS mime_type, message_id AS size_bytes FROM mail WHERE message_id % 4 = 2 AND message_id % 8 = 2)"


def _blobs(m: DataFrame) -> DataFrame:
    first = m.filter("message_id % 4 = 2 AND message_id % 8 = 2")
    return first.select(F.get("attachments", F.lit(0))["sha256"].alias("sha256"), F.lit("application/pdf").alias("mime_type"), F.col("message_id").alias("size_bytes"))


@query(_mail(f", {_BLOBS_SQL}, a AS (SELECT message_id, unnest(generate_series(0, CAST(len(names) AS INT) - 1)) AS position, unnest(names) AS filename FROM mail WHERE len(names) > 0) SELECT message_id, position, filename, mime_type, size_bytes FROM a LEFT JOIN blobs ON blobs.sha256 = sha256(filename)"))
def attachment_blob_hydrate(spark, sf_dir):
    m = mail(spark, sf_dir)
    return shapes.attachment_list(m, _blobs(m)).select("message_id", F.col("position").cast("long").alias("position"), "filename", "mime_type", "size_bytes")


@query(_mail("SELECT message_id, names[2] AS filename FROM mail WHERE len(names) > 1"))
def attachment_by_position(spark, sf_dir):
    return shapes.attachment_at(mail(spark, sf_dir), 1).select("message_id", "filename")


@query(_mail("SELECT sha256(name) AS sha256, name AS names FROM (SELECT DISTINCT unnest(names) AS name FROM mail)"))
def names_by_blob(spark, sf_dir):
    return shapes.names_by_blob(mail(spark, sf_dir)).select("sha256", F.array_join("names", ",").alias("names"))


@query(_mail(f", {_BLOBS_SQL} SELECT '.pdf' AS extension, count(*) AS n_blobs, CAST(sum(size_bytes) AS BIGINT) AS n_bytes FROM blobs HAVING count(*) > 0"))
def blobs_by_extension(spark, sf_dir):
    m = mail(spark, sf_dir)
    return shapes.blobs_by_extension(_blobs(m), m)


@query(_mail("SELECT body_lang, count(*) AS n FROM mail GROUP BY 1"))
def language_histogram(spark, sf_dir):
    return shapes.language_histogram(mail(spark, sf_dir))


@query(_mail("SELECT message_id, strftime(coalesce(internal_date, CASE WHEN message_id % 2 = 0 THEN TIMESTAMP '2024-01-02 03:04:05' END), '%Y-%m-%d') AS internal_day FROM mail"))
def internal_date_update_from(spark, sf_dir):
    m = mail(spark, sf_dir)
    known = m.filter("message_id % 2 = 0").select("message_id", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("internal_date"))
    return shapes.update_from(m, known, ["message_id"], ["internal_date"]).select("message_id", F.date_format("internal_date", "yyyy-MM-dd").alias("internal_day"))


_FAILED = "SELECT event_id AS failure_id, user_id % 5 AS account_id, user_id % 40 AS mailbox_id, ts AS failed_at, event_type = 'purchase' AS gave_up FROM events"


@query(f"WITH f AS ({_FAILED}) SELECT failure_id, 'acct' || account_id AS account, m.name AS mailbox FROM f LEFT JOIN (SELECT n_nationkey AS id, n_name AS name FROM nation) m ON m.id = mailbox_id WHERE NOT gave_up ORDER BY failed_at DESC, failure_id DESC LIMIT 200")
def failed_messages(spark, sf_dir):
    failures = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("failure_id"), (F.col("user_id") % 5).alias("account_id"), (F.col("user_id") % 40).alias("mailbox_id"), F.col("ts").alias("failed_at"), (F.col("event_type") == "purchase").alias("gave_up")
    )
    boxes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("mailbox_id"), F.col("n_name").alias("name"))
    return shapes.failed_messages(failures, accounts(spark), boxes, 200).select("failure_id", "account", "mailbox")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 0 ELSE CAST(user_id % 7 AS INTEGER) END AS retry_count, event_type <> 'click' AND user_id % 7 >= 5 AS gave_up FROM events")
def failures_retried(spark, sf_dir):
    ledger = table(spark, sf_dir, "events").withColumn("retry_count", (F.col("user_id") % 7).cast("int")).withColumn("gave_up", F.col("user_id") % 7 >= 5)
    return shapes.retried(ledger, F.col("event_type") == "click").select("event_id", "retry_count", "gave_up")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(CASE WHEN length(t) > 5000 THEN substr(t, 1, 5000) || chr(10) || '[truncated]' ELSE t END, '\\S+') AS w
  FROM (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda s: regexp_replace(regexp_replace(s, '[ \\t\\x0b\\f]+', ' ', 'g'), '^ | $', '', 'g')), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS t FROM documents)),
c AS (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - 17, 0), 112)) AS s FROM w WHERE len(w) > 0)
SELECT CAST(doc_id AS VARCHAR) AS sha256, s // 112 AS chunk_idx, array_to_string(w[s + 1:s + 128], ' ') AS text FROM c""")
def attachment_chunking(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sha256"), "text")
    return shapes.attachment_chunks(texts, 128, 16, 5000).withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


@query(_mail("""WITH w AS (SELECT message_id, regexp_extract_all(coalesce(body_text, ''), '\\S+') AS w FROM mail),
c AS (SELECT message_id, w[201:] AS w FROM w WHERE len(w) > 200), s AS (SELECT message_id, w, unnest(generate_series(0, greatest(len(w) - 65, 0), 448)) AS s FROM c)
SELECT message_id, 1 + s // 448 AS chunk_idx, 'body' AS kind, array_to_string(w[s + 1:s + 512], ' ') AS text FROM s
UNION ALL SELECT message_id, 0, 'header', '' FROM mail""".replace("WITH w", ", w", 1)))
def message_chunking(spark, sf_dir):
    made = shapes.body_chunks(mail(spark, sf_dir))
    return made.select("message_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "kind", F.when(F.col("kind") == "header", "").otherwise(F.col("text")).alias("text"))


@query(f"""WITH p AS (SELECT vec_id AS message_id, vec_id AS best_chunk_id, CASE WHEN vec_id % 3 = 0 THEN 'attachment_chunks' WHEN vec_id % 3 = 1 THEN 'message_chunks' END AS t FROM embeddings)
SELECT message_id, CASE t WHEN 'attachment_chunks' THEN 'file ' || best_chunk_id WHEN 'message_chunks' THEN 'chunk ' || best_chunk_id ELSE left(text, 20) END AS snippet, CASE WHEN t = 'attachment_chunks' THEN 'attachment' ELSE 'body' END AS snippet_source
FROM p JOIN documents ON doc_id = message_id""")
def hydrate_by_table(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("message_id"))
    kind = F.when(F.col("message_id") % 3 == 0, "attachment_chunks").when(F.col("message_id") % 3 == 1, "message_chunks")
    pool = ids.select("message_id", F.col("message_id").alias("best_chunk_id"), kind.alias("best_chunk_table"))
    texts = lambda word: ids.select(F.col("message_id").alias("chunk_id"), F.concat(F.lit(word), F.col("message_id").cast("string")).alias("text"))
    messages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id"), F.lit("").alias("subject"), F.lit("").alias("from_addr"), F.left("text", F.lit(20)).alias("body_text"))
    found = fusion.hydrate(pool, messages, texts("chunk "), [], 200, texts("file "))
    return found.select("message_id", "snippet", "snippet_source")


# The same shapes with every column that the ones above leave out.


@query(_mail("""SELECT CAST(message_id AS VARCHAR) AS message_id, subject, from_addr AS sender, from_name AS sender_name, CAST(message_id % 17 AS DOUBLE) / 16 AS score, left(body_text, 30) AS snippet, CASE WHEN message_id % 2 = 0 THEN '1,3' ELSE '2' END AS arms,
  'acct' || account_id AS account FROM mail WHERE message_id % 3 <> 0"""))
def api_hit_columns(spark, sf_dir):
    m = mail(spark, sf_dir)
    hits = m.filter("message_id % 3 <> 0").select("message_id", ((F.col("message_id") % 17) / 16).alias("score"), F.left("body_text", F.lit(30)).alias("snippet"), F.when(F.col("message_id") % 2 == 0, F.array(F.lit("1"), F.lit("3"))).otherwise(F.array(F.lit("2"))).alias("matched_arms"))
    found = shapes.api_hits(hits, m, accounts(spark))
    return found.select("message_id", "subject", F.col("from.address").alias("sender"), F.col("from.name").alias("sender_name"), "score", F.col("snippet_html").alias("snippet"), F.array_join("matched_arms", ",").alias("arms"), F.col("account.name").alias("account"))


def _named_blobs(m: DataFrame) -> DataFrame:
    """Messages whose attachments share blobs under several names and extensions."""
    files = F.array(F.struct(F.concat(F.lit("n"), F.col("message_id") % 7, F.element_at(F.array(F.lit(".PDF"), F.lit(".txt"), F.lit("")), (F.col("message_id") % 3 + 1).cast("int"))).alias("filename"), F.sha2((F.col("message_id") % 40).cast("string"), 256).alias("sha256")))
    return m.withColumn("attachments", files)


_NAMED_SQL = "named AS (SELECT message_id, 'n' || (message_id % 7) || ['.PDF', '.txt', ''][message_id % 3 + 1] AS filename, sha256(CAST(message_id % 40 AS VARCHAR)) AS sha256 FROM mail), stored AS (SELECT sha256, max(message_id % 40) AS size_bytes FROM named GROUP BY 1)"


@query(_mail(f", {_NAMED_SQL} SELECT sha256, string_agg(DISTINCT filename, ',' ORDER BY filename) AS names FROM named GROUP BY 1"))
def names_of_shared_blobs(spark, sf_dir):
    return shapes.names_by_blob(_named_blobs(mail(spark, sf_dir))).select("sha256", F.array_join("names", ",").alias("names"))


@query(_mail(f", {_NAMED_SQL} SELECT extension, count(*) AS n_blobs, CAST(sum(size_bytes) AS BIGINT) AS n_bytes FROM (SELECT DISTINCT sha256, nullif(lower(regexp_extract(filename, '.(\\.[^.]+)$', 1)), '') AS extension FROM named) JOIN stored USING (sha256) GROUP BY 1"))
def extensions_of_shared_blobs(spark, sf_dir):
    m = _named_blobs(mail(spark, sf_dir))
    blobs = m.groupBy(F.col("attachments")[0]["sha256"].alias("sha256")).agg(F.max(F.col("message_id") % 40).alias("size_bytes"))
    return shapes.blobs_by_extension(blobs, m)


_HYDRATED = "CASE t WHEN 'attachment_chunks' THEN 'file ' || text WHEN 'message_chunks' THEN 'chunk ' || text ELSE text END"


@query(f"""WITH p AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'attachment_chunks' WHEN vec_id % 3 = 1 THEN 'message_chunks' END AS t FROM embeddings),
s AS (SELECT vec_id, t, {_HYDRATED} AS x FROM p JOIN documents ON doc_id = vec_id),
c AS (SELECT *, least(nullif(instr(lower(x), 'nicht'), 0), nullif(instr(lower(x), 'with'), 0)) AS p FROM s)
SELECT vec_id AS message_id, CASE WHEN length(x) <= 200 THEN x WHEN p > 0 THEN CASE WHEN p > 101 THEN '…' ELSE '' END || substr(x, greatest(p - 101, 0) + 1, 200) || CASE WHEN greatest(p - 101, 0) + 200 < length(x) THEN '…' ELSE '' END
  ELSE regexp_replace(substr(x, 1, 200), '\\s+\\S*$', '') || '…' END AS snippet, CASE WHEN t = 'attachment_chunks' THEN 'attachment' ELSE 'body' END AS snippet_source FROM c""")
def hydrate_whole(spark, sf_dir):
    """Snippets around the search terms, from whole chunks of either kind or whole bodies."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id"), F.lit("").alias("subject"), F.lit("").alias("from_addr"), F.col("text").alias("body_text"))
    kind = F.when(F.col("message_id") % 3 == 0, "attachment_chunks").when(F.col("message_id") % 3 == 1, "message_chunks")
    pool = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("message_id"), F.col("vec_id").alias("best_chunk_id")).withColumn("best_chunk_table", kind)
    texts = lambda word: docs.select(F.col("message_id").alias("chunk_id"), F.concat(F.lit(word), "body_text").alias("text"))
    return fusion.hydrate(pool, docs, texts("chunk "), ["nicht", "with"], 200, texts("file ")).select("message_id", "snippet", "snippet_source")


@query(_mail("""SELECT message_id, concat_ws(' | ', CASE WHEN subject <> '' THEN 'Subject: ' || subject END, 'From: ' || from_name || ' <' || from_addr || '>', 'To: ' || array_to_string(to_addrs, ', '), 'Date: ' || strftime(date_sent, '%Y-%m-%dT%H:%M:%S'),
  nullif(array_to_string((regexp_extract_all(coalesce(body_text, ''), '\\S+'))[1:200], ' '), '')) AS text FROM mail"""))
def message_header_chunks(spark, sf_dir):
    return shapes.body_chunks(mail(spark, sf_dir)).filter("kind = 'header'").select("message_id", "text")


@query(_mail("""SELECT CAST(message_id AS VARCHAR) AS id, subject, from_addr || '/' || from_name AS sender, array_to_string(to_addrs, ',') AS receivers, from_addr AS copies, '' AS blind, strftime(date_sent, '%Y-%m-%dT%H:%M:%S') AS date,
  '<p>' || message_id || '</p><img src="/v1/attachments/' || sha256('pic' || message_id) || '"><img>' AS body_html, 'pic.png:' || sha256('pic' || message_id) || ':' || CASE WHEN message_id % 2 = 0 THEN 'image/png' ELSE '' END AS files, account_id || '/acct' || account_id || '/a' || account_id || '@x' AS account,
  mailbox_id || '/Box/' || folder AS folders FROM mail"""))
def message_details(spark, sf_dir):
    """Every message as it is shown, with an image of its own in its HTML."""
    m = mail(spark, sf_dir)
    sha = F.sha2(F.concat(F.lit("pic"), F.col("message_id").cast("string")), 256)
    html = F.concat(F.lit("<p onclick=x>"), F.col("message_id"), F.lit("</p><script>bad()</script><img src='cid:p"), F.col("message_id"), F.lit("'><img src='http://e/x.png'>"))
    pictures = F.array(F.struct(F.lit("pic.png").alias("filename"), sha.alias("sha256"), F.concat(F.lit("<p"), F.col("message_id"), F.lit(">")).alias("content_id")))
    full = m.withColumns({"body_html": html, "attachments": pictures, "cc_addrs": F.array("from_addr"), "bcc_addrs": F.lit(None).cast("array<string>")})
    blobs = m.filter("message_id % 2 = 0").select(sha.alias("sha256"), F.lit("image/png").alias("mime_type"), F.lit(1).cast("long").alias("size_bytes"))
    people = accounts(spark).withColumn("email_address", F.concat(F.lit("a"), "account_id", F.lit("@x")))
    got = shapes.details(full, people, labels(m), mailboxes(m), blobs)
    named = lambda c: F.array_join(F.transform(c, lambda x: x["address"]), ",").alias
    files = F.transform("attachments", lambda a: F.concat(a["filename"], F.lit(":"), a["sha256"], F.lit(":"), F.coalesce(a["mime_type"], F.lit(""))))
    return got.select(
        "id", "subject", F.concat_ws("/", "from.address", "from.name").alias("sender"), named("to")("receivers"), named("cc")("copies"), named("bcc")("blind"), "date", "body_html", F.array_join(files, ",").alias("files"),
        F.concat_ws("/", "account.id", "account.name", "account.address").alias("account"), F.array_join(F.transform("folders", lambda f: F.concat_ws("/", f["id"], f["name"])), ",").alias("folders"),
    )


# Control plane.


@query(f"SELECT event_type AS kind, NULLIF(user_id % 4, 0) AS account_id, strftime(max(ts), '{DAY_SQL}') AS last_beat, max(ts) < {NOW_SQL} - INTERVAL 3600 SECOND AS stale FROM events GROUP BY 1, 2")
def heartbeat_staleness(spark, sf_dir):
    beats = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.nullif(F.col("user_id") % 4, F.lit(0)).alias("account_id"), F.col("ts").alias("at"))
    return control.heartbeats(beats, NOW, 3600).select("kind", "account_id", F.date_format("last_at", DAY).alias("last_beat"), "stale")


_STATE = "CASE WHEN event_type = 'view' THEN 'queued' ELSE event_type END"


@query(f"SELECT user_id AS command_id FROM events GROUP BY 1 HAVING arg_max({_STATE}, (ts, {_STATE})) = 'queued' ORDER BY min(ts), 1 LIMIT 20")
def command_claim(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("command_id"), F.expr(_STATE).alias("state"), F.col("ts").alias("at"))
    return control.claimable(log, 20).select("command_id")


@query(f"SELECT user_id, count(*) FILTER (ts > {NOW_SQL} - INTERVAL 86400 SECOND) AS n FROM events GROUP BY 1")
def registration_rate(spark, sf_dir):
    return control.recent_count(table(spark, sf_dir, "events"), "user_id", "ts", NOW, 86400)


@query(f"SELECT event_id FROM events WHERE ts >= {NOW_SQL} - INTERVAL 432000 SECOND")
def retention_sweep(spark, sf_dir):
    return control.retained(table(spark, sf_dir, "events"), "ts", NOW, 432000).select("event_id")


@query("SELECT user_id, min(event_id) AS use_id FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'click' GROUP BY 1")
def single_use_codes(spark, sf_dir):
    uses = table(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("user_id").alias("code"), F.col("event_id").alias("use_id"), F.col("event_id").alias("at"))
    codes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_custkey").alias("user_id"))
    return control.burned(codes, uses, codes.select("user_id")).select("user_id", "use_id")


@query("SELECT n_nationkey AS account_id, n_name AS name, s IS NOT NULL AS granted FROM nation LEFT JOIN (SELECT DISTINCT s_nationkey AS s FROM supplier WHERE s_suppkey % 7 = 3) ON s = n_nationkey")
def account_grants(spark, sf_dir):
    grants = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("account_id"), (F.col("s_suppkey") % 7).alias("user_id")).distinct()
    named = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("account_id"), F.col("n_name").alias("name"))
    return control.users_with_grants(grants, named, grants, 3).select("account_id", "name", "granted")


@query("SELECT family FROM (SELECT user_id AS family, event_type || strftime(ts, '%Y%m%d%H') AS token, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1 HAVING max(n) = 1")
def token_families(spark, sf_dir):
    token = F.concat("event_type", F.date_format("ts", "yyyyMMddHH"))
    uses = table(spark, sf_dir, "events").select(F.col("user_id").alias("family"), token.alias("token"))
    return archive.live_families(uses)


@query(_mail("SELECT count(*) AS n_messages, round(avg(strlen(body_text)), 4) AS message_bytes, count(*) AS n_chunks, round(avg(strlen(body_text)), 4) AS chunk_bytes, round(2 * sum(strlen(body_text)) / 80e6, 4) AS rewrite_s, round(2 * sum(strlen(body_text)) / 30e6, 4) AS index_s FROM mail"))
def size_estimate(spark, sf_dir):
    m = mail(spark, sf_dir)
    return control.size_estimate(m, m.select(F.col("body_text").alias("text"))).select("n_messages", "n_chunks", *[F.round(c, 4).alias(c) for c in ("message_bytes", "chunk_bytes", "rewrite_s", "index_s")])


@query()
def language_detection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", language.detect(F.col("text")).alias("detected"))


_RUNS = " UNION ALL ".join(
    f"SELECT doc_id, lang, ({' + '.join(f'b[i + {j}] * CAST({ngrams.BASE ** (k - 1 - j)} AS BIGINT)' for j in range(k))}) % {ngrams.BUCKETS} + {(k - 1) * ngrams.BUCKETS} AS g FROM (SELECT doc_id, lang, b, unnest(generate_series(1, len(b) - {k - 1})) AS i FROM bytes)"
    for k in ngrams.LENGTHS
)


@query(f"""WITH bytes AS MATERIALIZED (SELECT doc_id, lang, list_transform(generate_series(1, len(h) // 2), lambda i: CAST((instr('0123456789ABCDEF', h[2 * i - 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i]) - 1 AS BIGINT)) AS b
  FROM (SELECT doc_id, lang, hex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)),
runs AS MATERIALIZED (SELECT doc_id, lang, g, count(*) AS n FROM ({_RUNS}) GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, g, sum(n) AS n FROM runs WHERE doc_id % 3 <> 1 AND lang IS NOT NULL GROUP BY ALL), t AS (SELECT lang, g // {ngrams.BUCKETS} AS k, sum(n) AS n FROM c GROUP BY ALL),
w AS (SELECT t.lang, g, CAST(floor({ngrams.SCALE}e0 * ln((coalesce(c.n, 0) + 1e0) / (t.n + {ngrams.BUCKETS}e0))) AS BIGINT) AS w FROM t JOIN (SELECT DISTINCT g FROM runs) ON g // {ngrams.BUCKETS} = k LEFT JOIN c USING (lang, g)),
s AS (SELECT doc_id, w.lang, sum(n * w) AS s FROM runs JOIN w USING (g) GROUP BY ALL)
SELECT d.doc_id, d.lang, detected FROM documents d LEFT JOIN (SELECT doc_id, arg_max(lang, (s, -ascii(lang) * 256 - ascii(lang[2]))) AS detected FROM s GROUP BY 1) x ON x.doc_id = d.doc_id""")
def language_ngrams(spark, sf_dir):
    """The language of all documents by n-grams, fitted on two thirds of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = ngrams.fit(docs.filter("doc_id % 3 <> 1"))
    return docs.select("doc_id", "lang", ngrams.detect(docs, model).alias("detected"))


#: Charsets that the Western texts are written in, a quarter in each.
_WRITTEN = ("utf-8", "cp1252", "cp850", "mac_roman")


@query()
def charset_detection(spark, sf_dir):
    """All documents written in one of four charsets and read again without being told which; models fitted on two thirds of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    samples = docs.filter("doc_id % 3 <> 1").select("text", F.explode(F.array(*map(F.lit, _WRITTEN[1:]))).alias("charset"))
    model = charset.fit(samples)
    written_in = F.element_at(F.array(*map(F.lit, _WRITTEN)), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    content = docs.withColumn("charset", written_in).withColumn("content", charset.encoded(F.col("text"), F.col("charset")))
    read = content.withColumn("found", charset.decoded(F.col("content"), model, docs))
    return read.select("doc_id", "charset", F.col("found.charset").alias("read_as"), F.round("found.confidence", 6).alias("confidence"), F.sha2("found.text", 256).alias("read_sha256"), F.col("found.text").eqNullSafe(F.col("text")).alias("same"))
