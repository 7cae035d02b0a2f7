"""The registered queries of this subpackage: one ``opN_<name>`` per
operator and ``pipeline``. Each applies the operator with production
parameters to its whole table and returns the full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlane.llm import ann, collocations, divergence, jaccard, langid, metric, mixing, packing, periodic, substring, tokens, toxicity, urls
from wattlane.llm.common import table

TOKENIZER = "byte_bpe_50k.json"


def op1_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every document after exact 20-word repeats go."""
    out = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document so that sources meet their weights."""
    return mixing.mixing_plan(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with 5-word-shingle Jaccard of 0.75 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors at cosine 0.9 or more."""
    return metric.range_join(table(spark, sf_dir, "embeddings"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: rules, then the language-model ratio."""
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels that are
    not held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; over_limit above 512 tokens."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document: base rules, then divergence
    from its language's reference."""
    out = divergence.quality(table(spark, sf_dir, "documents"))
    return out.drop("class_excess", "word_excess")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of two to four words."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, some of which stutter, and what is
    left without the repeats."""
    return periodic.digests(periodic.periodic_runs(table(spark, sf_dir, "documents"), rewrite=periodic.stutter))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_graph_neighbours": op1_graph_neighbours,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_language_id": op4_language_id,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_token_counts": op10_token_counts,
    "op11_quality_divergence": op11_quality_divergence,
    "op12_collocations": op12_collocations,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": pipeline,
}
_WORDS = r"""
w AS (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT doc_id, i, string_agg(word, ' ') OVER win AS q, count(*) OVER win AS c FROM p
      WINDOW win AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {follow} FOLLOWING))"""

_UPPER = "".join(map(chr, range(65, 91)))

# Words hold no spaces, so a joined window names its word sequence.
_OP2_SQL = "WITH" + _WORDS.format(text="coalesce(text, '')", follow=19) + """,
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY q ORDER BY doc_id, i) AS nth FROM g WHERE c = 20),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE nth > 1),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
d AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN d USING (doc_id)"""

_OP5_SQL = "WITH RECURSIVE" + _WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')", follow=4) + """,
s AS (SELECT DISTINCT doc_id, q FROM g WHERE c = 5
      UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.q = b.q AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e2.b FROM r JOIN e2 ON r.y = e2.a),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.x = d.doc_id"""

_OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, m.component_id, vec_id = m.component_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN m ON m.x = vec_id"""

_LOWER = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"

# Character classes as regular expressions (a class takes what those before left).
_CLASSES = [r"[^\p{Lu}]", r"[^\p{Ll}]", r"[^\p{Lt}\p{Lm}\p{Lo}]", r"[^\p{M}]", r"[^\p{N}]", None, r"[^\p{S}#*%&@\\_]", r"[^\p{Z}\x09-\x0D]"]


def _class_count(i: int) -> str:
    def left(pattern: str) -> str:
        return f"length(regexp_replace(t, '{pattern}', '', 'g'))"
    return left(_CLASSES[i]) if _CLASSES[i] else left(r"[^\p{P}]") + " - " + left(r"[^#*%&@\\_]")


_PUNCTUATION = divergence.PUNCTUATION.decode().replace("'", "''")

_OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT r, i, string_agg(word, ' ') OVER win AS q, count(*) OVER win AS c FROM p
      WINDOW win AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, q) AS m FROM g WHERE c = 3),
again AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 3)) FROM twice WHERE m > 1) GROUP BY r),
lines AS (SELECT r, line, count(*) AS m FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
dup AS (SELECT r, sum(m - 1) AS n FROM lines GROUP BY r),
b AS (SELECT r, doc_id, lang, t, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
             coalesce(again.n, 0) AS n_repeat_words, len(words) < 50 OR 100 * coalesce(again.n, 0) > 50 * len(words) AS base_failed
      FROM d LEFT JOIN dup USING (r) LEFT JOIN again USING (r)),
cc AS (SELECT r, lang, base_failed, length(t) AS chars, unnest(range(9)) AS class, unnest([{", ".join(map(_class_count, range(8)))}, -1]) AS n FROM b),
c9 AS (SELECT r, lang, base_failed, chars, class, CASE WHEN n < 0 THEN chars - sum(greatest(n, 0)) OVER (PARTITION BY r) ELSE n END AS n FROM cc),
bare AS (SELECT r, b.lang, base_failed, trim(translate(word, '{_UPPER}', '{_UPPER.lower()}'), '{_PUNCTUATION}') AS word FROM p JOIN b USING (r)),
total AS (SELECT lang, count(*) AS total FROM bare WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang),
large AS (SELECT * FROM total WHERE total * {divergence.LANGUAGE_SHARE} >= (SELECT sum(total) FROM total)),
common AS (SELECT lang, word, count(*) AS n, any_value(total) AS total FROM bare JOIN large USING (lang)
           WHERE NOT base_failed AND word <> '' AND strlen(word) <= {divergence.LONGEST}
           GROUP BY lang, word HAVING count(*) * {divergence.WORD_SHARE} >= any_value(total)),
wq AS (SELECT lang, word, n / total AS q FROM common
       UNION ALL SELECT lang, NULL, 1 - coalesce((SELECT sum(n) FROM common c WHERE c.lang = large.lang), 0) / total FROM large),
cq AS (SELECT lang, class, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM c9 JOIN large USING (lang) WHERE NOT base_failed GROUP BY lang, class),
wp AS (SELECT r, l.lang, c.word, count(*) AS n, any_value(n_words) AS total FROM bare JOIN b USING (r) JOIN large l ON l.lang = b.lang OR b.lang IS NULL
       LEFT JOIN common c ON c.lang = l.lang AND c.word = bare.word GROUP BY r, l.lang, c.word),
wd AS (SELECT r, lang, (sum(p * log2(2 * p / (p + q))) + 1 - sum(q) + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2 AS jsd,
              any_value(total) AS total
       FROM (SELECT r, wp.lang, n / total AS p, q, total FROM wp JOIN wq ON wq.lang = wp.lang AND wq.word IS NOT DISTINCT FROM wp.word) GROUP BY r, lang),
we AS (SELECT r, lang, any_value(jsd) - sum(m) - {divergence.DEVIATIONS} * sqrt(2 * sum(m * m)) AS e
       FROM (SELECT *, least(1 / (8 * ln(2) * total), q / 2) AS m FROM wd JOIN wq USING (lang) WHERE total >= {divergence.MIN_WORDS}) GROUP BY r, lang),
cd AS (SELECT r, lang, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 - m)
                       - {divergence.DEVIATIONS} * sqrt(2 * sum(m * m)) AS e
       FROM (SELECT r, cq.lang, n / chars AS p, q, least(1 / (8 * ln(2) * chars), q / 2) AS m FROM c9 JOIN cq ON cq.class = c9.class AND (cq.lang = c9.lang OR c9.lang IS NULL)
             WHERE chars >= {divergence.MIN_CHARS}) GROUP BY r, lang),
e AS (SELECT b.r, arg_min(we.e, coalesce(we.e, 0) * 1000 + coalesce(cd.e, 0)) AS w, arg_min(cd.e, coalesce(we.e, 0) * 1000 + coalesce(cd.e, 0)) AS c
      FROM b JOIN large l ON l.lang = b.lang OR b.lang IS NULL
      LEFT JOIN we ON we.r = b.r AND we.lang = l.lang LEFT JOIN cd ON cd.r = b.r AND cd.lang = l.lang GROUP BY b.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(w > {divergence.WORD_LIMIT}, false) AND NOT coalesce(c > {divergence.CLASS_LIMIT}, false) AS kept
FROM b LEFT JOIN e USING (r)"""

_OP12_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, len, array_to_string(ws[i:i + len - 1], ' ') AS phrase
      FROM (SELECT lang, ws, len, unnest(range(1, len(ws) - len + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS len))),
f AS (SELECT lang, len, phrase, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len = 1 GROUP BY lang),
c AS (SELECT lang, len, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE len > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, a, ws, unnest(range(1, len)) AS k FROM c),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f))::BIGINT AS score FROM cuts
           JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[:k], ' ')
           JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase
          FROM (SELECT lang, a, ws, m, unnest(range(1, len - m + 2)) AS i FROM (SELECT *, unnest(range(2, len)) AS m FROM c))),
more AS (SELECT lang, phrase, max(a) AS most FROM parts GROUP BY ALL),
stay AS (SELECT best.* FROM best LEFT JOIN more USING (lang, phrase) WHERE NOT coalesce(100::HUGEINT * most >= 80::HUGEINT * a, false))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM stay JOIN total USING (lang) QUALIFY rank <= 2000"""

SQL: dict[str, str] = {
    "op2_substring_dedup": _OP2_SQL,
    "op5_ngram_jaccard": _OP5_SQL,
    "op6_embedding_dedup": _OP6_SQL,
    "op11_quality_divergence": _OP11_SQL,
    "op12_collocations": _OP12_SQL,
}
