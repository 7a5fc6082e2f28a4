"""The corpus queries of the driver contract; each reads whole tables and returns its full result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import huffman, langid, toxicity
from lectern.llm.alignment import align_documents
from lectern.llm.chunk_dedup import chunk_duplicates
from lectern.llm.codebooks import compress
from lectern.llm.exact_dedup import exact_duplicates
from lectern.llm.fingerprints import fingerprint_edits
from lectern.llm.minhash import near_duplicates
from lectern.llm.mixing import WEIGHTS, domain_of_source, mix
from lectern.llm.packing import pack
from lectern.llm.quality import judge
from lectern.llm.suffix_dedup import suffix_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), domain_of_source(), WEIGHTS)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_duplicates(_table(spark, sf_dir, "documents"), whole_copies=True)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op7_huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_duplicates(_table(spark, sf_dir, "documents"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_chunk_dedup": op4_chunk_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_huffman_files": op7_huffman_files,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_packing": op9_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_fingerprints": op11_fingerprints,
    "op12_alignment": op12_alignment,
    "op13_vector_codes": op13_vector_codes,
}

def _level(n: int, keys: list[str], source: str, budget: str, weight: str) -> str:
    """One level of the budget tree in SQL: as fill()."""
    child, part = keys[-1], ", ".join(keys[:-1]) or "1"
    return f"""
a{n} AS (SELECT *, supply / weight AS ratio FROM (SELECT {", ".join(f"x.{k}" for k in keys)}, x.supply, {budget} AS budget, {weight} AS weight FROM {source})),
b{n} AS (SELECT *, coalesce(sum(supply) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used,
   sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS free FROM a{n} WINDOW w AS (PARTITION BY {part} ORDER BY ratio, {child})),
c{n} AS (SELECT *, bool_and(supply * free <= weight * (budget - used)) OVER (PARTITION BY {part} ORDER BY ratio, {child} ROWS UNBOUNDED PRECEDING) AS short FROM b{n}),
d{n} AS (SELECT *, CASE WHEN short THEN 0 ELSE weight END AS w, (budget - sum(CASE WHEN short THEN supply ELSE 0 END) OVER (PARTITION BY {part}))::BIGINT AS rest FROM c{n}),
e{n} AS (SELECT *, greatest(1, sum(w) OVER (PARTITION BY {part}))::BIGINT AS total, (sum(w) OVER (PARTITION BY {part} ORDER BY ratio, {child} ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM d{n}),
s{n} AS (SELECT {", ".join(keys)}, CASE WHEN short THEN supply ELSE (rest * upto) // total - (rest * (upto - w)) // total END AS share FROM e{n})"""


def mix_sql(percent: int = 60) -> str:
    """The mix in SQL, for a budget of ``percent`` of all words."""
    return rf"""
WITH r AS (SELECT doc_id, coalesce(['web', 'books', 'reference', 'forum'][try_cast(regexp_extract(source, '(\d+)$', 1) AS INT) % 4 + 1], 'unknown') AS domain,
   coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
rows_ AS (SELECT * FROM r WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * 4)::BIGINT AS supply FROM rows_ GROUP BY ALL),
l1 AS (SELECT domain, sum(supply)::BIGINT AS supply FROM leaf GROUP BY ALL),
l2 AS (SELECT domain, lang, sum(supply)::BIGINT AS supply FROM leaf GROUP BY ALL),
{_level(1, ["domain"], "l1 x", f"(SELECT least(sum(supply), (sum(tokens) * {percent}) // 100) FROM leaf)::BIGINT", "CASE domain WHEN 'web' THEN 40 WHEN 'books' THEN 25 WHEN 'reference' THEN 20 WHEN 'forum' THEN 15 ELSE 1 END")},
{_level(2, ["domain", "lang"], "l2 x JOIN s1 USING (domain)", "s1.share", "CASE lang WHEN 'en' THEN 55 WHEN 'de' THEN 15 WHEN 'fr' THEN 15 WHEN 'es' THEN 15 ELSE 1 END")},
{_level(3, ["domain", "lang", "source"], "leaf x JOIN s2 USING (domain, lang)", "s2.share", "1")},
plan AS (SELECT domain, lang, source, share // tokens AS whole, share % tokens AS rest FROM leaf JOIN s3 USING (domain, lang, source)),
keyed AS (SELECT *, ('0x' || md5('17:' || whole || ':' || doc_id)[1:15])::BIGINT AS k FROM rows_ JOIN plan USING (domain, lang, source)),
upto AS (SELECT *, rest - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, n_tokens, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM keyed),
taken AS (SELECT domain, lang, source, doc_id, unnest(range(whole)) AS epoch, n_tokens, n_tokens AS taken_tokens FROM upto
   UNION ALL SELECT domain, lang, source, doc_id, whole, n_tokens, least(room, n_tokens) FROM upto WHERE room > 0)
SELECT domain, lang, source, doc_id, epoch::INT AS epoch, n_tokens, taken_tokens::BIGINT AS taken_tokens, ('0x' || md5('17:' || epoch || ':' || doc_id)[1:15])::BIGINT AS order_key FROM taken
"""

def codes_sql(rounds: int = 6) -> str:
    """Product quantisation in SQL: Lloyd's rounds one after the other, each part compared with each entry."""

    def nearest(n: int) -> str:
        return f"""n{n} AS MATERIALIZED (SELECT q.r, q.part, q.v, min((x.d, x.entry)) AS best FROM parts q, LATERAL (SELECT b.entry, list_sum(list_transform(range(1, 9), lambda i: (q.v[i] - b.v[i]) * (q.v[i] - b.v[i])))::BIGINT AS d
   FROM b{n} b WHERE b.part = q.part) x GROUP BY ALL)"""

    steps = []
    for n in range(rounds):
        sums = ", ".join(f"floor(sum(v[{i}])::HUGEINT / count(*))::BIGINT" for i in range(1, 9))
        steps.append(f"""{nearest(n)},
m{n} AS (SELECT part, best[2] AS entry, [{sums}] AS v FROM n{n} GROUP BY ALL),
b{n + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{n} b LEFT JOIN m{n} m ON m.part = b.part AND m.entry = b.entry)""")
    steps.append(nearest(rounds))
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
   WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
parts AS MATERIALIZED (SELECT r, p AS part, v[p * 8 + 1:p * 8 + 8] AS v FROM kept, range(8) t(p)),
firsts AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id, min(r) AS r FROM kept GROUP BY vec_id ORDER BY vec_id LIMIT 16)),
b0 AS (SELECT part, entry, v FROM parts JOIN firsts USING (r)),
{", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM n{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), books
"""


ORACLE_SQL = {
    "op13_vector_codes": codes_sql(),
    "op1_mixing": mix_sql(),
    "op5_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
      FROM d WINDOW w AS (PARTITION BY t ORDER BY length(text) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM r
""",
}
