"""The registered queries of the text operators, and SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import alignment, bpe, collocations, exact_dedup, fingerprints, idfiles, langid, packing, simhash, substrings, tokencount, topk, warc
from ledgerline.llm.common import documents
from ledgerline.llm.units import tokenizer_path

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(documents(spark, sf_dir))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = idfiles.write_ids(documents(spark, sf_dir), tokenizer_path(WORD_BPE), end_id=2, kind="folded")
    return idfiles.read_ids(spark, files)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), tokenizer_path(WORD_BPE))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_hex(simhash.near_duplicates(documents(spark, sf_dir)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.train_and_identify(documents(spark, sf_dir))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(spark, warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path(BYTE_BPE), end_id=0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir), tokenizer_path(PIECES))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(documents(spark, sf_dir), tokenizer_path(BYTE_BPE), tokenizer_path(PIECES))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_substrings": op2_substrings,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_id_files": op4_id_files,
    "op5_bpe": op5_bpe,
    "op6_simhash": op6_simhash,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_alignment": op11_alignment,
    "op12_topk": op12_topk,
    "op13_collocations": op13_collocations,
}

ORACLES = {
    "op2_substrings": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS g FROM d, unnest(range(1, len(ws) - 18)) AS t(s)),
        later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, p FROM later, unnest(range(s, s + 20)) AS t(p)),
        words AS (SELECT doc_id, p, ws[p] AS word FROM d, unnest(range(1, len(ws) + 1)) AS t(p)),
        kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS kept, count(*) AS n FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY w.doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op8_warc": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (1 + ((((strpos('0123456789abcdef', substr(hex, (i * 5) // 4 + 1, 1)) - 1) * 16
                          + greatest(strpos('0123456789abcdef', substr(hex || '0', (i * 5) // 4 + 2, 1)) - 1, 0)) >> (3 - (i * 5) % 4)) & 31))::BIGINT, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM h""",
    "op12_topk": r"""
        WITH v AS (SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 50 = 0)
        SELECT query_id, rank, vec_id, score
        FROM (SELECT *, (row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 5""",
    "op13_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
        g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT *, unnest(range(1, 6)) AS k FROM p))),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 100),
        inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, a FROM (SELECT lang, a, ws, j, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM c))) GROUP BY ALL),
        kept AS (SELECT c.* FROM c LEFT JOIN inside s ON s.lang = c.lang AND s.phrase = c.phrase WHERE s.longer IS NULL OR 100 * s.longer < 100 * c.a),
        parts AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
        big AS (SELECT lang, phrase, a FROM f WHERE a >= 100),
        cuts AS (SELECT p.lang, p.phrase, p.a, l.a AS l, r.a AS r, n.n, j, ((1000::HUGEINT * p.a * n.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
                 FROM parts p JOIN n ON n.lang = p.lang JOIN big l ON l.lang = p.lang AND l.phrase = p.lp JOIN big r ON r.lang = p.lang AND r.phrase = p.rp),
        least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
        SELECT lang, rank, phrase, a, l, r, n, score
        FROM (SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::INT AS rank FROM least) WHERE rank <= 2000""",
}
