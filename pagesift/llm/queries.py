"""The registered queries of the training-data operators and their DuckDB SQL.

Each query applies one operator with its production parameters to its whole
table and derives the digest columns; see the operators for defined cases.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm import bpe, bytecnn, fingerprint, linededup, merkle, mixing, neardup, pii, runs, tokenfile, topk, toxicity, wrapper
from pagesift.llm.common import ascii_lower, is_held_out, shared_path, table


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _scored(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select(F.col("id").alias("doc_id"), is_held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(toxicity.score(docs, model), 0.5)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (neardup.near_duplicates(table(spark, sf_dir, "documents"))
            .withColumnsRenamed({"id": "doc_id", "component": "component_id"}))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfile.write(table(spark, sf_dir, "documents"), shared_path(spark, "tokens"), vocabulary("word_bpe_49k.json"), end_id=2)
    return tokenfile.read(files, digest=True).withColumnRenamed("id", "doc_id")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return wrapper.extract(pages, wrapper.induce(pages)).withColumnRenamed("id", "page_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = bytecnn.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(bytecnn.score(docs, net), 0.3)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return hits.withColumnRenamed("id", "vec_id")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0,
                      merkle.leaf(*[ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in columns]))
    found = merkle.manifest(docs, columns, extra={"tampered": tampered})
    folded = found.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return folded.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _cycled(doc_id, words: list) -> list:
    """One document in ten repeats a stretch of its words from some word on."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=_cycled)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("b"),
                       sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), sha(F.col("text")).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", (-F.col("b.s")).alias("start"), "b.length", (-F.col("b.p")).alias("period"),
                      F.expr("1000 * b.length div -b.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = linededup.kept(docs, linededup.bitmaps(docs))
    return rest.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_bpe, op3_fingerprint, op4_pii, op5_near_duplicates, op6_token_files, op7_main_text, op8_mixing,
                                   op9_quality, op10_topk, op11_merkle, op12_runs, op13_lines)}

#: crc32 of a short text in SQL: eight steps of the reflected polynomial for each byte.
_CRC32 = """
crc AS (SELECT doc_id, xor(list_reduce(list_transform(range(strlen(d)), lambda i: ascii(substr(d, (i + 1)::INT, 1))::BIGINT),
            lambda r, b: list_reduce(list_transform(range(8), lambda k: k::BIGINT), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
                                     xor(r, b)), 4294967295), 4294967295) AS crc
        FROM (SELECT DISTINCT doc_id, doc_id::VARCHAR AS d FROM documents))"""

ORACLE_SQL = {
    "op13_lines": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, o, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT r, o, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
first AS (SELECT key, min(o) AS first FROM l WHERE length(key) >= 10 GROUP BY key),
k AS (SELECT r, count(*) AS n_lines, count(*) FILTER (o > first) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (first IS NULL OR o = first) AS rest
      FROM l LEFT JOIN first USING (key) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(rest, '')) AS kept_sha256 FROM d JOIN k USING (r)""",
    "op11_merkle": f"""
WITH RECURSIVE {_CRC32},
f AS (SELECT d.*, crc % 3 = 0 AS tampers, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
      FROM documents d LEFT JOIN crc ON crc.doc_id IS NOT DISTINCT FROM d.doc_id),
l AS (SELECT doc_id, lang, tampers, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
             || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
             sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS other FROM f),
leaves AS (SELECT doc_id, leaf, CASE WHEN tampers THEN other ELSE leaf END AS start, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
                  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
tree(g, lvl, pos, n, h) AS (SELECT g, 0, pos, n, leaf FROM leaves UNION ALL
    SELECT g, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, lvl, pos // 8, n),
sub AS (SELECT g, lvl AS height, h AS subroot FROM tree WHERE n = 1),
crown(lvl, pos, n, h) AS (SELECT 0, g, count(*) OVER (), subroot FROM sub UNION ALL
    SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY lvl, pos // 8, n),
top AS (SELECT h AS root FROM crown WHERE n = 1),
runs AS (SELECT g, lvl, pos // 8 AS up, list(h ORDER BY pos) AS hs FROM tree WHERE n > 1 GROUP BY ALL),
crowns AS (SELECT lvl, pos // 8 AS up, list(h ORDER BY pos) AS hs FROM crown WHERE n > 1 GROUP BY ALL),
steps AS (SELECT a.g, a.pos, r.lvl, r.hs, (a.pos // (8 ** r.lvl)::BIGINT) % 8 AS slot FROM leaves a JOIN runs r ON r.g = a.g AND r.up = a.pos // (8 ** (r.lvl + 1))::BIGINT
          UNION ALL SELECT a.g, a.pos, sub.height + c.lvl, c.hs, (a.g // (8 ** c.lvl)::BIGINT) % 8 FROM leaves a JOIN sub USING (g)
          JOIN crowns c ON c.up = a.g // (8 ** (c.lvl + 1))::BIGINT),
paths AS (SELECT g, pos, list(array_to_string(hs[:slot], '') || '|' || array_to_string(hs[slot + 2:], '') ORDER BY lvl) AS path FROM steps GROUP BY g, pos)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(replace(array_to_string(path, ''), '|', ''), '')) AS proof_sha256,
       CASE WHEN path IS NULL THEN start ELSE list_reduce(path, lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2)), start) END AS folded_root,
       folded_root = root AS verified
FROM leaves JOIN sub USING (g) CROSS JOIN top LEFT JOIN paths USING (g, pos)""",
    "op10_topk": """
WITH parts AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
whole AS (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL EXCEPT
          SELECT vec_id FROM parts WHERE x IS NULL OR NOT isfinite(x)),
v AS (SELECT vec_id, i, floor(64 * x)::BIGINT AS x FROM parts SEMI JOIN whole USING (vec_id)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20""",
}
