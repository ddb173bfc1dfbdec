"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.base import OWN, folds, table
from riskloom.llm.brown import class_scores
from riskloom.llm.collocations import collocations
from riskloom.llm.langid import predict_language
from riskloom.llm import licences
from riskloom.llm.pivots import near_vectors
from riskloom.llm.raking import mix
from riskloom.llm.simhash import hex_fingerprint, near_duplicates
from riskloom.llm.squares import FIELDS, periodic_runs
from riskloom.llm.substrings import remove_repeats
from riskloom.llm.tokens import token_counts
from riskloom.llm.warc import archive_folder, read_archives, write_archives
from riskloom.llm.winnow import contamination
from riskloom.llm.wrappers import main_text


def op1_wrapper_induction(spark: SparkSession, sf: str) -> DataFrame:
    out = main_text(table(spark, sf, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col(f"{OWN}text").alias("text"), F.length(f"{OWN}text").cast("long").alias("n_chars"))


def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = remove_repeats(table(spark, sf, "documents").select("doc_id", "text"), with_kept=False)
    return out.select(
        "doc_id", F.col(f"{OWN}size").alias("n_bytes"), F.col(f"{OWN}removed").alias("n_removed"),
        F.col(f"{OWN}spans").alias("n_spans"), F.col(f"{OWN}sha").alias("kept_sha256"),
    )


def op3_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    out = contamination(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    names = ["n_words", "n_hit", "n_items"]
    digest = F.sha2(F.concat_ws(",", F.col(f"{OWN}items")), 256)
    return out.select(
        "doc_id", *[F.col(f"{OWN}{c}").alias(c) for c in names], digest.alias("items_sha256"),
        F.col(f"{OWN}contaminated").alias("contaminated"),
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents
), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark
), dp AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d
), bp AS (SELECT item_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM b
), dn AS (SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS nxt FROM dp
), bn AS (SELECT item_id, i, list(x) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS nxt FROM bp
), m AS (
  SELECT doc_id, item_id, dn.i, 13 AS l FROM dn JOIN (SELECT DISTINCT item_id, nxt FROM bn WHERE len(nxt) = 13) USING (nxt)
  UNION ALL
  SELECT doc_id, item_id, dn.i, len(b.w) FROM dn JOIN b ON dn.nxt[1] = b.w[1] AND dn.nxt[1:len(b.w)] = b.w WHERE len(b.w) < 13
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM m) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    folder = archive_folder(pages)
    return read_archives(write_archives(pages, folder), folder).drop("url", "payload")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), k AS (SELECT page_id, strlen(html) AS n, sha1(html) AS d,
  CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY sha1(html)) END AS keeper FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM k
"""


def op5_licence_digests(spark: SparkSession, sf: str) -> DataFrame:
    out = licences.scan_licences(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col(f"{OWN}digest").alias("digest"), F.col(f"{OWN}licence").alias("licence"))


# The canonical form once more, written for itself: lines that go, then single words, then spellings.
_LICENCE_WORDS = r"""trim(regexp_replace(array_to_string(list_filter(
  string_split(translate(lower_ascii, '‘’“”–—', $$''""--$$), chr(10)),
  lambda x: NOT (regexp_matches(x, '^[ \t*#;/]*(copyright[ ,]*(\(c\)|©|[12]\d\d\d|by [^ ])|(\(c\)|©) *[12]\d\d\d)')
      AND NOT regexp_matches(x, 'free software|[<\[{]|yy|year|notice|holder|owner|law'))
    AND NOT regexp_full_match(trim(translate(x, chr(9) || chr(13), '  ')),
      '(the )?mit licen[sc]e|(the )?mit license \(mit\)|expat license|(the )?isc license|isc license \(isc\)|(the )?bsd license|bsd [23]-clause license|(the )?[23]-clause bsd license|bsd 2-clause "simplified" license|bsd 3-clause "new" or "revised" license|(simplified|new|revised|modified) bsd license')
  ), chr(10)), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"""
_SAME = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "cancelled": "canceled", "centre": "center", "favour": "favor", "fulfil": "fulfill",
    "https": "http", "judgement": "judgment", "labour": "labor", "licence": "license", "licenced": "licensed", "organisation": "organization",
    "whilst": "while", "wilful": "willful", "copyright holder": "copyright owner", "copyright holders": "copyright owners",
    "non commercial": "noncommercial", "per cent": "percent", "sub license": "sublicense",
}


def _licence_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licences.known_texts().items())
    padded = "' ' || replace(w, ' ', '  ') || ' '"
    for old, new in [("all rights reserved", ""), *sorted(_SAME.items(), key=lambda x: licences.SPELLINGS.index(x))]:
        padded = f"replace({padded}, {quoted(' ' + old.replace(' ', '  ') + ' ')}, {quoted(' ' + new.replace(' ', '  ') + ' ' if new else ' ')})"
    return f"""
WITH given AS (
  SELECT NULL AS doc_id, l AS licence, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM (VALUES {known}) AS v(l, t)
  UNION ALL SELECT doc_id, NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM documents
), words AS (SELECT doc_id, licence, {_LICENCE_WORDS} AS w FROM given
), form AS (SELECT doc_id, licence, sha256(trim(regexp_replace({padded}, ' +', ' ', 'g'))) AS digest FROM words
), k AS (SELECT digest, min(licence) AS licence FROM form WHERE licence IS NOT NULL GROUP BY 1)
SELECT d.doc_id, d.digest, k.licence FROM form d LEFT JOIN k USING (digest) WHERE d.licence IS NULL
"""


OP5_SQL = _licence_sql()


def op6_byte_network(spark: SparkSession, sf: str) -> DataFrame:
    held_out = folds(F.col("doc_id"), 4) == 2
    out = predict_language(table(spark, sf, "documents").select("doc_id", "text", "lang"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), F.col(f"{OWN}lang_pred").alias("lang_pred"), F.col(f"{OWN}score").alias("score"))


def op7_raking(spark: SparkSession, sf: str) -> DataFrame:
    out = mix(table(spark, sf, "documents").select("doc_id", "text", "source", "lang"))
    names = ["topic", "tokens", "rate", "weight", "selected"]
    return out.select("doc_id", "source", "lang", *[F.col(f"{OWN}{c}").alias(c) for c in names])


def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    out = near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", hex_fingerprint(F.col(f"{OWN}fp")).alias("fingerprint"), F.col(f"{OWN}component").alias("component_id"))


def op9_pivot_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    out = near_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return out.select(
        "vec_id", F.col(f"{OWN}n_links").alias("n_links"), F.col(f"{OWN}component_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col(f"{OWN}component_id"), F.lit(False)).alias("kept"),
    )


def op10_brown_classes(spark: SparkSession, sf: str) -> DataFrame:
    held_out = folds(F.col("doc_id"), 7) == 2
    out = class_scores(table(spark, sf, "documents").select("doc_id", "text"), ~held_out)
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return out.select("doc_id", held_out.alias("held_out"), *[F.col(f"{OWN}{c}").alias(c) for c in names])


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    out = periodic_runs(table(spark, sf, "documents").select("doc_id", "text"), plant=True)
    return out.select("doc_id", *[F.col(f"{OWN}{c}").alias(c) for c in FIELDS])


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(table(spark, sf, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH w AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^ 	]+') AS x FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)
), t AS (SELECT lang, sum(len(x)) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, m, array_to_string(x[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, x, m, unnest(range(1, len(x) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS o(m))
), f AS (SELECT lang, m, phrase, count(*) AS a, string_split(phrase, ' ') AS y FROM g GROUP BY lang, m, phrase HAVING count(*) >= 30
), c AS (SELECT * FROM f WHERE m >= 2
), cut AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, CAST(2000000 AS HUGEINT) * c.a // (CAST(l.a AS HUGEINT) + r.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.y[1:k], ' ') AND l.m = k
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.y[k + 1:c.m], ' ') AND r.m = c.m - k
), least AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(y[i:i + q - 1], ' ') AS phrase, q, a
  FROM (SELECT lang, y, a, q, unnest(range(1, m - q + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS q FROM c))
), most AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY lang, phrase
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM least s LEFT JOIN most USING (lang, phrase) WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN t USING (lang) WHERE rank <= 2000
"""


def op13_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    out = token_counts(table(spark, sf, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    names = {"bytes": "n_bytes", "tokens": "n_tokens", "over_limit": "over_limit"}
    return out.select("doc_id", *[F.col(f"{OWN}{a}").alias(b) for a, b in names.items()])


# name: (query, oracle SQL or None)
QUERIES = {
    "op1_wrapper_induction": (op1_wrapper_induction, None),
    "op2_suffix_dedup": (op2_suffix_dedup, None),
    "op3_winnowing": (op3_winnowing, OP3_SQL),
    "op4_warc": (op4_warc, OP4_SQL),
    "op5_licence_digests": (op5_licence_digests, OP5_SQL),
    "op6_byte_network": (op6_byte_network, None),
    "op7_raking": (op7_raking, None),
    "op8_simhash": (op8_simhash, None),
    "op9_pivot_neighbours": (op9_pivot_neighbours, None),
    "op10_brown_classes": (op10_brown_classes, None),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_collocations": (op12_collocations, OP12_SQL),
    "op13_token_counts": (op13_token_counts, None),
}
