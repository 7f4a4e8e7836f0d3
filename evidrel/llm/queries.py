"""The registered queries of this subpackage: queries() and oracle_sql() parts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrel.llm import ann, bytebpe, jaccard, langid, linededup, merkle, mixing, pieces, pii, topk, toxicity, vafile, webpage
from evidrel.llm.common import fold, table
from evidrel.llm.shards import usable


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the network learns from rows whose fold of 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 5) != 0))
    out = langid.identify(docs, model, columns=[F.col("doc_id")])
    return out.select("doc_id", (F.coalesce(fold("doc_id", 5), F.lit(1)) == 0).alias("held_out"), "lang_pred", "score")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are 90 % alike."""
    out = jaccard.join_classes(table(spark, sf_dir, "documents"), n=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT x.a, x.b FROM (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS k FROM s JOIN s t ON s.g = t.g AND s.doc_id <> t.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * x.k >= 90 * (na.n + nb.n - x.k)
), r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = d.doc_id
"""


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every twentieth vector."""
    v = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", zero=True)
    v = v.withColumn("v", F.transform("v", lambda x: F.floor(x * 64).cast("double")))
    out = topk.top_k(v, F.col("vec_id") % 20 == 0, 20)
    return out.withColumn("score", F.col("score").cast("long"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE)))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


#: The model file of op4 and of the pipeline; set EVIDREL_PIECES to use another.
PIECE_MODEL = os.environ.get("EVIDREL_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document: their number, the digest of their ids, and whether decoding gives the text back."""
    model = pieces.read_model(PIECE_MODEL)
    docs = table(spark, sf_dir, "documents")
    ids = pieces.encode(docs, model, columns=[F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")])
    out = pieces.decode(ids, model)
    digest = F.sha2(F.array_join("piece_ids", ",").cast("binary"), 256)
    return out.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), digest.alias("ids_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of rows whose fold of 3 is not 1 train the network."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold("doc_id", 3) != 1)
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model, columns=[F.col("doc_id")])
    return out.select("doc_id", (F.coalesce(fold("doc_id", 3), F.lit(0)) == 1).alias("held_out"), "score", "predicted")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the 20 nearest vectors of every twentieth vector."""
    v = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", zero=False)
    return ann.nearest(v, F.col("vec_id") % 20 == 0, 20)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 code points that 5 documents hold stay in the largest of them only."""
    out = linededup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: Parts of all tokens that the domains of the labels shall have: a quarter or less of what poor and toxic texts have by nature stays.
DOMAIN_WEIGHTS = {"clean": 0.95, "poor": 0.03, "toxic": 0.02}


def label_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the labelled documents."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "poor")
    return table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors, fitted rate and copies of every document."""
    out = mixing.mix(table(spark, sf_dir, "documents"), label_domains(spark, sf_dir), DOMAIN_WEIGHTS, keep="clean")
    p = [F.element_at("p", k + 1).alias(f"p_{d}") for k, d in enumerate(sorted(DOMAIN_WEIGHTS))]
    return out.select("doc_id", "tokens", *p, "rate", "copies")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans and what the field adds."""
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs), columns=[F.col("doc_id")])


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return webpage.main_text(table(spark, sf_dir, "pages"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), l AS (
  SELECT r, doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
), f AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT any_value(l.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.keeper <> l.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.keeper IS NULL OR l.doc_id IS NULL OR f.keeper = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY l.r
"""


LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that its leaf gives where every third document's text was lower-cased."""
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(fold("doc_id", 3) == 0, F.lit(False))
    found = F.when(tampered, merkle.leaf(*LEAF[:-1], lowered)).otherwise(merkle.leaf(*LEAF))
    folded = merkle.fold(F.col("found"), F.col("proof"))
    out = merkle.manifest(docs, merkle.leaf(*LEAF), "lang", ["doc_id"], {"found": found}, ["doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root")])
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Trees bottom-up by recursion (the subroots' tree as group level 2), then each document's path; crc32 from its rule.
OP11_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
  SELECT *, CASE WHEN doc_id IS NULL THEN false ELSE xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 END AS bad FROM documents, crc
), f AS (
  SELECT doc_id, bad, lang, {head} AS head, {text} AS orig, {low} AS low FROM d
), l AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256(head || orig) AS leaf, sha256(head || CASE WHEN bad THEN low ELSE orig END) AS found FROM f
), p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l
), t(g, lev, i, n, h) AS (
  SELECT g, 0::BIGINT, i::BIGINT, n::BIGINT, leaf FROM p
  UNION ALL SELECT g, lev + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, lev, i // 8
), s AS (SELECT g, lev AS top, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1
), u(lev, i, n, h) AS (
  SELECT 0::BIGINT, i::BIGINT, n::BIGINT, subroot FROM s
  UNION ALL SELECT lev + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lev, i // 8
), sib AS (
  SELECT a.g, a.lev, a.i, string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i) AS lo, string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i) AS hi FROM t a JOIN t b ON a.g = b.g AND a.lev = b.lev AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.g, a.lev, a.i
), usib AS (
  SELECT a.lev, a.i, string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i) AS lo, string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i) AS hi FROM u a JOIN u b ON a.lev = b.lev AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.lev, a.i
), w(doc_id, g, leaf, pos, lev, i, h, proof) AS (
  SELECT doc_id, g, leaf, i, 0::BIGINT, i::BIGINT, found, '' FROM p
  UNION ALL SELECT w.doc_id, w.g, leaf, pos, w.lev + 1, w.i // 8, sha256(coalesce(lo, '') || w.h || coalesce(hi, '')), proof || coalesce(lo, '') || coalesce(hi, '') FROM w JOIN sib ON sib.g = w.g AND sib.lev = w.lev AND sib.i = w.i
), x(doc_id, g, leaf, pos, subroot, lev, i, h, proof) AS (
  SELECT doc_id, w.g, leaf, pos, subroot, 0::BIGINT, s.i::BIGINT, h, proof FROM w JOIN s ON s.g = w.g AND s.top = w.lev
  UNION ALL SELECT doc_id, x.g, leaf, pos, subroot, x.lev + 1, x.i // 8, sha256(coalesce(lo, '') || x.h || coalesce(hi, '')), proof || coalesce(lo, '') || coalesce(hi, '') FROM x JOIN usib ON usib.lev = x.lev AND usib.i = x.i
)
SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, x.h AS folded_root, x.h = u.h AS verified FROM x JOIN u ON u.n = 1 AND u.lev = x.lev
""".replace("{head}", " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in LEAF[:-1])).replace(
    "{text}", "coalesce(strlen(text) || ':' || text, '-')").replace("{low}", "coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')")


#: The vocabulary of op12; set EVIDREL_BYTE_BPE to use another.
BYTE_BPE = os.environ.get("EVIDREL_BYTE_BPE")


def byte_model() -> bytebpe.Model:
    """The public vocabulary and its pattern."""
    import public_tokenizers

    return bytebpe.read_model(BYTE_BPE or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and the digests of their ids and of the bytes that decoding them gives."""
    model = byte_model()
    ids = bytebpe.encode(table(spark, sf_dir, "documents"), model, columns=[F.col("doc_id")])
    out = bytebpe.decode(ids, model)
    digest = F.sha2(F.array_join("token_ids", ",").cast("binary"), 256)
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector and each of its five nearest of its label: the ten best rows of other labels inside the score window."""
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = usable(e.withColumn("label", label), "vec_id", "embedding", zero=True, keep=["label"])
    v = v.withColumn("v", F.transform("v", lambda x: F.floor(x * 256).cast("double")))
    out = vafile.hard_negatives(v, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)
    return out.withColumns({c: F.col(c).cast("long") for c in ("positive_score", "negative_score")})


OP13_SQL = """
WITH v AS (
  SELECT vec_id, min({'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, 'v': list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))}) AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.r.label = c.r.label AS same, CAST(list_dot_product(a.r.v, c.r.v) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(a.r.v) = len(c.r.v) WHERE a.vec_id % 100 = 0
), p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_exact_topk": op3_exact_topk,
    "op4_pieces": op4_pieces,
    "op5_toxicity": op5_toxicity,
    "op6_ann": op6_ann,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_html": op10_html,
    "op11_merkle": op11_merkle,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op2_jaccard_join": OP2_SQL,
    "op3_exact_topk": OP3_SQL,
    "op7_line_dedup": OP7_SQL,
    "op11_merkle": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
