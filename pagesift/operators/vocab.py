"""Vocabularies and term embeddings (A-01, A-02, E-05, E-06, S-16, J-04..J-06).

E-05 is a deterministic sub-word embedding: the character n-grams (3..6)
of ``<term>`` each get a pseudo-random 30-vector derived from md5, and a
term's vector is their average. It needs no training, covers any unseen
term, and is identical in Spark and DuckDB. E-06 trains Spark ML Word2Vec
on the characters of each term (each term is one sentence of characters).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift import config as C

_NAME_RE = r"^<([A-Za-z][^\t\n\r\f />\x00]*+)"
# the class attribute's value, double-, single- or un-quoted (groups 1, 2, 3), behind the attributes before it
CLASS_ATTR_RE = (rf"(?i)^<{C.TAG_NAME}(?:(?!class[{C.BLANK}]*+=)(?:[{C.BLANK}]++|/(?!>)|{C.ATTRIBUTE_ONLY}))*+class[{C.BLANK}]*+=++[{C.BLANK}]*+"
                 rf"""(?:"([^"]*+)"|'([^']*+)'|((?!["'])[^>{C.BLANK}]*+))""")


def class_value(tag_text):
    """Value of the class attribute of a raw start tag ('' when absent). Tags without the word are not searched three times."""
    found = F.concat(*[F.regexp_extract(tag_text, CLASS_ATTR_RE, g) for g in (1, 2, 3)])
    return F.when(tag_text.isNull() | F.lower(tag_text).contains("class"), found).otherwise(F.lit(""))


def raw_start_tags(pages: DataFrame) -> DataFrame:
    """(page_id, tag_text) for every start tag the parser sees in the raw page: bodies of comments
    and of script and style elements are text to it."""
    h = F.regexp_replace("html", C.COMMENT_OR_RAW_RE, "$1$3")
    markup = rf"({C.START_TAG_RE})|{C.END_TAG_RE}|{C.DECLARATION_RE}|{C.OPEN_MARKUP_RE}"
    return (pages.select("page_id", F.explode(F.regexp_extract_all(h, F.lit(markup), 1)).alias("t"))
            .filter(F.col("t") != ""))


def tag_vocab(pages: DataFrame) -> DataFrame:
    """A-01: distinct lower-case tag names with page and use counts."""
    t = raw_start_tags(pages).select(
        "page_id", F.lower(F.regexp_extract("t", _NAME_RE, 1)).alias("term"))
    return t.groupBy("term").agg(F.countDistinct("page_id").alias("pages"), F.count("*").alias("uses"))


def class_vocab(pages: DataFrame) -> DataFrame:
    """A-02: distinct class strings, blanks normalised to one space."""
    t = raw_start_tags(pages).select(class_value(F.col("t")).alias("c"))
    t = t.select(F.trim(F.regexp_replace("c", rf"[{C.BLANK}]+", " ")).alias("term")).filter(F.col("term") != "")
    return t.groupBy("term").agg(F.count("*").alias("uses"))


def vocab_terms(pages: DataFrame) -> DataFrame:
    """(kind, term) of both vocabularies (A-01 tags, A-02 classes) from one scan of the raw pages."""
    name = F.lower(F.regexp_extract("t", _NAME_RE, 1))
    cls = F.trim(F.regexp_replace(class_value(F.col("t")), rf"[{C.BLANK}]+", " "))
    both = raw_start_tags(pages).select(F.explode(F.array(
        F.struct(F.lit("tag").alias("kind"), name.alias("term")),
        F.struct(F.lit("class").alias("kind"), cls.alias("term")))).alias("k"))
    return both.select("k.*").filter(F.col("term") != "").distinct()


def ngram_rows(terms: DataFrame, keys=("term",)) -> DataFrame:
    """(keys..., ngram) for n in 3..6 over '<term>' (none for very short terms)."""
    w = F.concat(F.lit("<"), F.col("term"), F.lit(">"))
    grams = F.expr(
        f"flatten(transform(sequence({C.NGRAM_MIN}, {C.NGRAM_MAX}), n -> "
        f"CASE WHEN length(w) >= n THEN transform(sequence(1, length(w) - n + 1), i -> substring(w, i, n)) "
        f"ELSE array() END))")
    return terms.select(*keys, w.alias("w")).select(*keys, F.explode_outer(grams).alias("ngram"))


def hash_vectors(terms: DataFrame, keys=("term",)) -> DataFrame:
    """E-05 long form: (keys..., dim, value); a term without n-grams is the zero vector.

    ``keys`` may add a namespace column (e.g. ``kind``) so several
    vocabularies are embedded in one pass."""
    keys = list(keys)
    g = ngram_rows(terms.select(*keys).distinct(), keys)
    g = g.select(*keys, "ngram", F.explode(F.sequence(F.lit(0), F.lit(C.EMBED_DIM - 1))).alias("dim"))
    h = F.conv(F.substring(F.md5(F.concat_ws("#", "ngram", F.col("dim").cast("string"))), 1, 7), 16, 10)
    u = (h.cast("double") / float(0xFFFFFFF)) * (2.0 / C.EMBED_DIM) - (1.0 / C.EMBED_DIM)
    v = F.when(F.col("ngram").isNull(), F.lit(0.0)).otherwise(u)
    return g.select(*keys, "dim", v.alias("v")).groupBy(*keys, "dim").agg(F.avg("v").alias("value"))


def wide(long: DataFrame, key="term") -> DataFrame:
    """(term, dim, value) -> (term, vector array<double>) ordered by dim."""
    key = [key] if isinstance(key, str) else list(key)
    return long.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("vector"))


def minmax_vector(col):
    """S-16: (x-min)/(max-min); a flat vector becomes zeros instead of dividing by zero."""
    lo, hi = F.array_min(col), F.array_max(col)
    return F.transform(col, lambda x: F.coalesce((x - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)))


def minmax_vectors(long: DataFrame, keys=("term",)) -> DataFrame:
    """S-16 long form of min-max normalised vectors."""
    keys = list(keys)
    w = wide(long, keys)
    w = w.select(*keys, minmax_vector(F.col("vector")).alias("vector"))
    return w.select(*keys, F.posexplode("vector").alias("dim", "value"))


def w2v_char_vectors(vocab: DataFrame, seed: int = C.FOLD_SEED, max_iter: int = 10) -> DataFrame:
    """E-06 training: one Word2Vec per kind over the characters of each vocabulary
    term (a term is a sentence, a character a word); (kind, ch, vector)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array
    out = None
    for kind in ("tag", "class"):
        chars = vocab.filter(F.col("kind") == kind).select(F.split("term", "").alias("chars")) \
                     .filter(F.size("chars") > 0)
        w2v = Word2Vec(vectorSize=C.EMBED_DIM, windowSize=5, minCount=1, maxIter=max_iter, seed=seed,
                       inputCol="chars", outputCol="vec")
        vec = w2v.fit(chars).getVectors()  # one row per distinct character
        part = vec.select(F.lit(kind).alias("kind"), F.col("word").alias("ch"),
                          vector_to_array("vector").alias("vector"))
        out = part if out is None else out.unionByName(part)
    return out


def w2v_term_vectors(used: DataFrame, char_vectors: DataFrame) -> DataFrame:
    """E-06 lookup: a term's vector is the mean of its characters' trained vectors;
    a character the model never saw takes its E-05 sub-word vector. The
    character table is small (one row per distinct character); the planner
    broadcasts it by its measured size."""
    ch = used.select("kind", "term", F.posexplode(F.split("term", "")).alias("i", "ch")).filter(F.col("ch") != "")
    known = ch.join(char_vectors, ["kind", "ch"], "left")
    missing = known.filter(F.col("vector").isNull()).select("kind", F.col("ch").alias("term")).distinct()
    fallback = wide(hash_vectors(missing, ("kind", "term")), ("kind", "term")) \
        .select("kind", F.col("term").alias("ch"), F.col("vector").alias("fb"))
    full = known.join(fallback, ["kind", "ch"], "left") \
                .select("kind", "term", F.coalesce("vector", "fb").alias("vector"))
    long = full.select("kind", "term", F.posexplode("vector").alias("dim", "value"))
    mean = wide(long.groupBy("kind", "term", "dim").agg(F.avg("value").alias("value")), ("kind", "term"))
    zeros = used.select("kind", "term").join(mean.select("kind", "term"), ["kind", "term"], "left_anti") \
                .select("kind", "term", F.array_repeat(F.lit(0.0), C.EMBED_DIM).alias("vector"))
    return mean.unionByName(zeros)  # '' (no class) has no characters: zeros


def kind_term_vectors(used: DataFrame, vocab: DataFrame, char_vectors: DataFrame | None = None) -> DataFrame:
    """J-04/J-05 for both kinds at once: (kind, term, vector) for the used
    (kind, term) pairs; vocabulary terms min-max normalised (S-16), others raw.
    With ``char_vectors`` the trained E-06 embedding is used, else E-05."""
    if char_vectors is not None:
        v = w2v_term_vectors(used, char_vectors)
    else:
        v = wide(hash_vectors(used, ("kind", "term")), ("kind", "term"))
    v = v.join(vocab.select("kind", "term", F.lit(True).alias("in_vocab")).distinct(), ["kind", "term"], "left")
    vec = F.when(F.col("in_vocab"), minmax_vector(F.col("vector"))).otherwise(F.col("vector"))
    return v.select("kind", "term", vec.alias("vector"))


def vocab_misses(node_terms: DataFrame, vocab_terms: DataFrame) -> DataFrame:
    """J-06: terms used by nodes that the vocabulary lacks."""
    return node_terms.select("term").distinct().join(vocab_terms.select("term"), "term", "left_anti")
