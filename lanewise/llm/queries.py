"""Registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced, byte_pieces, collocations, imatch, kneser_ney, piece_sampling, reply_trees, simhash_trie, soft_mixing, spelling, subword_classifier, token_frames, url_rules
from .shared import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _left_out(mod: int, rest: int):
    """Whether crc32 of the document id as text leaves ``rest`` modulo ``mod``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


#: Wanted shares of all tokens: domains named by the labels of quality and toxicity.
TARGETS = {"clean": 0.86, "poor": 0.08, "toxic": 0.06}


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id and domain of labelled documents; rows without a label of quality name none."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


@query()
def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model of the training documents, applied to all."""
    docs = _table(spark, sf_dir, "documents")
    model = kneser_ney.fit(docs.filter(~_left_out(7, 2)), "text")
    return kneser_ney.score(docs, model, "doc_id", "text").select(
        "doc_id", _left_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


_OP2 = r"""
WITH numbered AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS total FROM documents
), texts AS (
  SELECT a.doc_id, a.r, a.n, a.text,
    substr(a.text, 1, a.n - a.n // 4) || substr(b.text, 1, a.n // 4) AS edited
  FROM numbered a JOIN numbered b ON b.r = a.r % a.total + 1
), cut AS (
  SELECT r, 0 AS which, unnest(list_distinct(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'))) AS term FROM texts
  UNION ALL
  SELECT r, 1, unnest(list_distinct(string_split_regex(lower(edited), '[^\p{L}\p{M}\p{N}]+'))) FROM texts
), band AS (
  SELECT term FROM cut WHERE which = 0 AND term <> '' GROUP BY term
  HAVING count(*) >= {low} * (SELECT count(*) FROM texts) AND count(*) <= {high} * (SELECT count(*) FROM texts)
), rates AS (SELECT k, [{rates}][k // {each} + 1] AS rate FROM range({subsets}) t(k)),
member AS (
  SELECT term, k FROM band, rates WHERE ('0x' || substr(md5(term || ':' || k), 1, 8))::BIGINT % rate = 0
), digits AS (
  SELECT r, which, k, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 4) AS d
  FROM cut JOIN member USING (term) GROUP BY r, which, k
), has AS (SELECT DISTINCT r, which FROM cut JOIN band USING (term)),
prints AS (
  SELECT r, which, string_agg(coalesce(d, '----'), '' ORDER BY k) AS fp
  FROM has CROSS JOIN rates LEFT JOIN digits USING (r, which, k) GROUP BY r, which
), both_ AS (
  SELECT t.doc_id, t.r, t.n, sha256(t.edited) AS edited_sha256,
    coalesce(p.fp, md5(t.text)) AS fingerprint, coalesce(e.fp, md5(t.edited)) AS edited_fingerprint
  FROM texts t LEFT JOIN prints p ON p.r = t.r AND p.which = 0 LEFT JOIN prints e ON e.r = t.r AND e.which = 1
), paired AS (
  SELECT a.*, b.fingerprint AS next_fingerprint FROM both_ a JOIN both_ b ON b.r = a.r % (SELECT count(*) FROM texts) + 1
)
SELECT doc_id, n AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
  {near_edited} AS near_edited, {near_next} AS near_next FROM paired
"""


def _likeness_sql(a: str, b: str) -> str:
    cut = f"[x for x in [[substr({a}, k * 4 + 1, 4), substr({b}, k * 4 + 1, 4)] for k in range({imatch.SUBSETS})] if x <> ['----', '----']]"
    whole = 4 * imatch.SUBSETS
    return (
        f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN length({a}) <> {whole} OR length({b}) <> {whole} THEN 0.0::DOUBLE"
        f" ELSE len([y for y in {cut} if y[1] = y[2]])::DOUBLE / len({cut}) END"
    )


def _op2_sql() -> str:
    fixed = {
        "low": f"{imatch.LOW}::DOUBLE",
        "high": f"{imatch.HIGH}::DOUBLE",
        "rates": ", ".join(map(str, imatch.RATES)),
        "each": str(imatch.EACH),
        "subsets": str(imatch.SUBSETS),
        "near_edited": _likeness_sql("fingerprint", "edited_fingerprint"),
        "near_next": _likeness_sql("fingerprint", "next_fingerprint"),
    }
    sql = _OP2
    for name, value in fixed.items():
        sql = sql.replace("{" + name + "}", value)
    return sql


@query(_op2_sql())
def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts, of their edited forms, and their likeness to the next text's."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = stored(imatch.lexicon(docs, "text"), "lexicon")
    placed = imatch.in_order(docs, "doc_id", F.xxhash64("text"))
    paired = imatch.with_next(placed, "text", "following")
    n = F.length("text").cast("long")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(
        F.col("text").substr(F.lit(1), (n - quarter).cast("int")), F.col("following").substr(F.lit(1), quarter)
    )
    texts = paired.select("bucket", "place", "doc_id", n.alias("n_chars"), "text", edited.alias("edited")).withColumn(
        "edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)
    )
    prints = stored(
        imatch.fingerprints(
            texts, ["bucket", "place"], {"text": "fingerprint", "edited": "edited_fingerprint"}, words, ["doc_id", "n_chars", "edited_sha256"]
        ),
        "prints",
    )
    return imatch.with_next(prints, "fingerprint", "following").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        imatch.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        imatch.likeness(F.col("fingerprint"), F.col("following")).alias("near_next"),
    )


_EXTRA_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]

_OP3 = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 17)::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id
"""


@query(_OP3)
def op3_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as one-branch reply trees, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(_EXTRA_CONVERSATION, rows.schema)
    messages = reply_trees.chained(rows.unionByName(extra), "conv_id", ["turn"], "role", "text")
    done = reply_trees.format_trees(messages)
    read = done.select(
        F.col("tree").alias("conv_id"),
        "formatted",
        reply_trees.read_turns(F.col("formatted")).alias("turns"),
        reply_trees.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_OP4 = r"""
WITH cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(h, p, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
judged AS (
  SELECT page_id, host, path,
    (SELECT max(struct_pack(size := length(h) + length(p), rule := h || p, action := action)) FROM rules
     WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS won
  FROM cut
)
SELECT page_id, host, path, won.rule AS rule, coalesce(won.action, 'allow') AS verdict FROM judged
"""


@query(_OP4)
def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the rule table."""
    rules = spark.createDataFrame(_RULES, "host string, path string, action string")
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), rules, "page_id", "url")


@query()
def op5_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all texts, learnt from the training share of the labels."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(~_left_out(5, 0))
    model = subword_classifier.fit(docs, labels, "doc_id", "text", "quality")
    return subword_classifier.score(docs, model, "text").select(
        "doc_id",
        _left_out(5, 0).alias("held_out"),
        "score",
        (F.col("score") >= subword_classifier.ACCEPT).cast("int").alias("predicted"),
    )


@query()
def op6_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    path = public_tokenizers.path("word_bpe_49k.json")
    files = token_frames.write_tokens(_table(spark, sf_dir, "documents"), "doc_id", "text", path, 2)
    return token_frames.read_tokens(files)


@query()
def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of all texts, with a checksum of the text they decode to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents")
    return piece_sampling.sample_pieces(docs, "doc_id", "text", path)


@query()
def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that bring the domains of the labels to their target shares of all tokens."""
    docs = _table(spark, sf_dir, "documents")
    mixed = soft_mixing.mix(docs, domain_labels(_table(spark, sf_dir, "labels")), "doc_id", "text", TARGETS)
    return mixed.select(
        "doc_id", "tokens", *[F.col("posteriors")[i].alias(f"p_{d}") for i, d in enumerate(TARGETS)], "rate"
    )


@query()
def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return simhash_trie.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text")


_OP10 = """
WITH used AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM used q JOIN used c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query(_OP10)
def op10_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best rows by integer inner product for every fiftieth vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    return bitsliced.top_inner_products(vectors, vectors.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5)


@query()
def op11_byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all texts by byte-level BPE, and the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = byte_pieces.encode(_table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return byte_pieces.decode(tokens, path).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents
), said AS (
  SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda w: w <> '') AS words FROM pieces
), totals AS (SELECT lang, sum(len(words)) AS n FROM said GROUP BY lang),
sizes AS (SELECT unnest(range(1, 6)) AS size),
starts AS (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM said, sizes WHERE len(words) >= size),
known AS (SELECT lang, words[i : i + size - 1] AS phrase, count(*) AS f FROM starts GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, f AS a, unnest(range(1, len(phrase))) AS k FROM known WHERE len(phrase) > 1),
rated AS (
  SELECT c.lang, c.phrase, a, k, p.f AS l, q.f AS r, n, (1000::HUGEINT * a * n) // (p.f::HUGEINT * q.f) AS score
  FROM cuts c JOIN known p ON p.lang = c.lang AND p.phrase = c.phrase[:k] JOIN known q ON q.lang = c.lang AND q.phrase = c.phrase[k + 1:]
    JOIN totals t ON t.lang = c.lang
), weakest AS (
  SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score FROM weakest w WHERE NOT EXISTS (
    SELECT 1 FROM known o WHERE o.lang = w.lang AND len(o.phrase) > len(w.phrase) AND 100 * o.f >= 100 * w.a
      AND contains(' ' || array_to_string(o.phrase, ' ') || ' ', ' ' || array_to_string(w.phrase, ' ') || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


@query(_OP12)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of each language that belong together most."""
    return collocations.collocations(_table(spark, sf_dir, "documents"), "text", "lang")


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with their likeliest spellings."""
    found = spelling.variants(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("word", "form", "root", "n", "n_near", "form_n")
