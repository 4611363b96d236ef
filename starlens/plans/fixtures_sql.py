"""DuckDB forms of the fixture views (V1 reviews, V2 review_texts, V3 lexicon) for the SQL oracles.

They mirror ``starlens.sources.tables`` expression for expression; the oracle side prepends them as CTEs.
"""

REVIEWS = """
reviews AS (
  SELECT md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
             CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS INT) AS VARCHAR),
             CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR))) AS review_id,
         p_type AS category,
         concat('P', CAST(l_partkey AS VARCHAR)) AS asin,
         concat('B', p_brand) AS parent_asin,
         concat('U', CAST(o_custkey AS VARCHAR)) AS user_id,
         p_name AS title,
         1 + (CAST(l_quantity AS INT) + CAST(l_partkey AS INT)) % 5 AS rating,
         CASE WHEN l_linenumber = 7 AND l_suppkey % 5 = 0 THEN NULL
              ELSE 1 + (CAST(l_quantity AS INT) + CAST(l_partkey AS INT)
                        + CASE WHEN l_discount >= 0.07 THEN 2 ELSE 0 END) % 5 END AS predict_stars,
         l_returnflag <> 'R' AS verified_purchase,
         CAST(round(l_tax * 100) AS BIGINT) AS helpful_vote,
         l_shipdate AS review_time
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""

# reviews with the resolved key names and the mismatch flag
PREPARED = """
prepared AS (
  SELECT *, asin AS product_id,
         coalesce(abs(predict_stars - rating) >= 2, false) AS is_misleading
  FROM reviews
)"""

REVIEW_TEXTS = """
review_texts AS (
  SELECT doc_id AS review_id, source AS asin, concat('U', CAST(doc_id % 97 AS VARCHAR)) AS user_id, lang AS category,
         CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN '  '
              ELSE concat(lang, ' review ', CAST(doc_id AS VARCHAR)) END AS title,
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE text END AS text,
         CAST(1 + doc_id % 5 AS INT) AS rating,
         CASE WHEN doc_id % 29 = 0 THEN NULL ELSE CAST(1 + (doc_id + doc_id % 7) % 5 AS INT) END AS predict_stars,
         doc_id % 4 <> 0 AS verified_purchase,
         doc_id % 13 AS helpful_vote,
         1577836800000 + (doc_id % 1900) * 86400000 + (doc_id % 24) * 3600000 AS timestamp,
         CAST((doc_id % 35 - doc_id % 7) / 7 AS INT) AS topic,
         CASE WHEN doc_id % 3 = 0 THEN NULL ELSE list_resize(CAST([] AS VARCHAR[]), doc_id % 3, 'img') END AS images
  FROM documents
)"""

LEXICON = r"""
lexicon AS (
  SELECT term AS token, CAST(CAST(('0x' || substr(md5(term), 1, 4)) AS BIGINT) % 9 AS INT) - 4 AS valence
  FROM (SELECT term, count(*) AS n
        FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents)
        GROUP BY term ORDER BY n DESC, term LIMIT 500)
)"""

# Python-style whitespace and word classes (identical strings in Spark/Java and DuckDB/RE2).
WS = r"[\x{09}-\x{0D}\x{1C}-\x{1F}\x{85}\p{Z}]"


def word_count_sql(expr: str) -> str:
    return f"CAST(coalesce(len(list_filter(regexp_split_to_array({expr}, '{WS}+'), lambda w: w <> '')), 0) AS INT)"


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def merged_space_sql(title: str = "title", text: str = "text") -> str:
    return f"concat(coalesce({title}, ''), ' ', coalesce({text}, ''))"


def length_bucket5_sql(words: str) -> str:
    return (
        f"CASE WHEN {words} > 0 AND {words} <= 20 THEN 'Very Short' WHEN {words} > 20 AND {words} <= 50 THEN 'Short' "
        f"WHEN {words} > 50 AND {words} <= 100 THEN 'Medium' WHEN {words} > 100 AND {words} <= 200 THEN 'Long' "
        f"WHEN {words} > 200 THEN 'Very Long' END"
    )


# review_texts prepared the RQ2 way: merged text (space), > 20 chars, word counts, buckets, gaps, flag
TEXTS_PREPARED = (
    """
texts_prepared AS (
  SELECT *, """
    + length_bucket5_sql("text_length")
    + """ AS length_category
  FROM (
    SELECT *, """
    + word_count_sql("review_text")
    + """ AS review_words, """
    + word_count_sql("text")
    + """ AS text_length,
           predict_stars - rating AS rating_diff,
           coalesce(abs(predict_stars - rating) >= 2, false) AS is_misleading
    FROM (SELECT *, asin AS product_id, """
    + merged_space_sql()
    + """ AS review_text FROM review_texts)
    WHERE length(review_text) > 20
  )
)"""
)


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
