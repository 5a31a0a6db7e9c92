"""Line dedup by a log-template tree.

Every line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, where a token
with a digit, an address or a link counts as a variable. The lines of a leaf are generalised to templates: a
token that fewer than ``min_docs`` lines (each distinct line once per document) have at its place is a variable
field. A template that recurs in ``min_docs`` documents or more, with at least ``min_constant`` of its tokens
constant, is boilerplate: its lines are dropped wherever they stand, save at the template's first occurrence
(smallest doc_id, then line), so that nothing is lost from the corpus altogether.

A fixed ``min_docs`` makes frequent field values constant in a large leaf. With ``rungs`` a token's documents are
therefore held against min_docs, twice that, four times that and so on, and a line takes the highest rung at which its
template is still steady. The lines of a lower rung's template share their higher ones too, so the highest holds all
that a lower one finds. Of a template that D documents share, the rung above D / 2 leaves at most one value a field
standing, whatever the size of the leaf.

All levels are map-side combined counts and equi-joins. Leaves that too few documents share are pruned first, so
only recurring leaves' lines are taken apart into tokens; a leaf, line or token that a third of all documents
share is one partial count per task. No leaf is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH = 3            # leading tokens that lead to a leaf
MIN_DOCS = 3         # documents in which a template recurs
MIN_TOKENS = 3       # shorter lines are left alone
MIN_CONSTANT = 0.6   # share of a template's tokens that must be constant
BROADCAST_ROWS = 200_000
VARIABLE = "<*>"

_SEPARATORS = " \t\x0b\f\r"


def _tokens(line: Column) -> Column:
    return F.split(F.btrim(line, F.lit(_SEPARATORS)), "[\\x20\\x09\\x0B-\\x0D]+", -1)


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]|@|://"), F.lit(VARIABLE)).otherwise(t))


def _checked(df: DataFrame) -> DataFrame:
    """Checkpointed; broadcast if the count of its rows allows."""
    df = df.checkpoint(eager=True)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def recurring_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS,
                    min_constant: float = MIN_CONSTANT, id_col: str = "doc_id", text_col: str = "text",
                    rungs: bool = False) -> DataFrame:
    """(doc_id, line_no, template): every occurrence of a recurring template but its first; line_no from 0.

    Lines of fewer than ``min_tokens`` tokens and blank lines are left alone.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where(
        F.col("doc_id").isNotNull())
    # Leaves: one hash per line; a leaf counts once per document.
    # Lines are cut into tokens inside the generator, so that the filter on their number does not repeat the cutting.
    # Only a leaf's own tokens are masked here; the rest of a line waits until its leaf is known to recur.
    lines = texts.select("doc_id", F.posexplode(F.transform(F.split("text", "\n", -1), _tokens)).alias("line_no", "raw"))
    lines = lines.where((F.size("raw") >= min_tokens) & (F.col("raw")[0] != "")).select(
        "doc_id", "line_no", "raw", F.xxhash64(F.size("raw"), _masked(F.slice("raw", 1, depth))).alias("leaf"))
    leaves = (lines.groupBy("leaf", "doc_id").agg(F.lit(1).alias("one"))
              .groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"))
    found = (lines.join(_checked(leaves), "leaf", "left_semi")
             .select("doc_id", "line_no", "leaf", _masked(F.col("raw")).alias("tokens"))
             .withColumn("kind", F.xxhash64("tokens")).checkpoint(eager=True))

    # Constants: tokens that enough of the leaf's lines have at their place.
    kinds = (found.groupBy("leaf", "kind", "doc_id").agg(F.first("tokens").alias("tokens"))
             .groupBy("leaf", "kind").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n")))
    placed = kinds.select("leaf", "kind", "n", F.posexplode("tokens").alias("place", "token"))
    constant = (placed.groupBy("leaf", "place", "token").agg(F.sum("n").alias("n"))
                .where((F.col("n") >= min_docs) & (F.col("token") != VARIABLE)))
    rung = F.length(F.bin(F.floor(F.col("n") / min_docs))) - 1 if rungs else F.lit(0)  # binary digits: an exact log2
    constant = constant.select("leaf", "place", "token", rung.alias("rung"))
    kinds = (placed.join(constant, ["leaf", "place", "token"], "left").groupBy("leaf", "kind")
             .agg(F.array_sort(F.collect_list(F.struct("place", "token", "rung"))).alias("places")))
    # Only a rung just above that of one of the line's own constants masks more than the one below it.
    above = F.transform(F.filter("places", lambda x: x["rung"].isNotNull() & (x["place"] >= depth)), lambda x: x["rung"] + 1)
    tried = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), above))) if rungs else F.array(F.lit(0))
    shown = F.transform(tried, lambda k: F.transform("places", lambda x: F.when(
        (x["rung"] >= k) | (x["place"] < depth), x["token"]).otherwise(F.lit(VARIABLE))))
    steady = F.filter(shown, lambda t: F.size(F.filter(t, lambda x: x != VARIABLE)) >= min_constant * F.size(t))
    template = (kinds.select("leaf", "kind", F.explode(F.slice(steady, -1, 1)).alias("parts"))
                .select("leaf", "kind", F.array_join("parts", " ").alias("template")))

    # Recurrence over documents, and the first occurrence.
    placed_lines = (found.select("doc_id", "line_no", "leaf", "kind").join(template, ["leaf", "kind"])
                    .select("doc_id", "line_no", "template").checkpoint(eager=True))
    first_of_doc = placed_lines.groupBy("template", "doc_id").agg(F.min("line_no").alias("line_no"))
    recurring = (first_of_doc.groupBy("template")
                 .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line_no")).alias("first"))
                 .where(F.col("n") >= min_docs).select("template", "first"))
    return (placed_lines.join(_checked(recurring), "template")
            .where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("line_no") != F.col("first.line_no")))
            .select("doc_id", "line_no", "template"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """``docs`` with recurring lines dropped from its text, plus ``n_lines`` and ``n_dropped``.

    Lines are the parts between ``\\n``; kept lines are joined by ``\\n`` again. A null text stays null (no lines),
    an empty text is one empty line. Rows with the same doc_id count as one document: they lose the same lines.
    Rows without a doc_id are left alone. ``n_lines`` and ``n_dropped`` replace columns of those names.
    """
    dropped = (recurring_lines(docs, id_col=id_col, text_col=text_col, **rules)
               .groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("line_no").alias("__drop")))
    d = docs.join(_checked(dropped), F.col(f"`{id_col}`") == F.col("__doc"), "left")
    none = F.array().cast("array<int>")
    d = (d.withColumn("__drop", F.coalesce("__drop", none))
         .withColumn("__lines", F.coalesce(F.split(F.col(f"`{text_col}`"), "\n", -1), F.array().cast("array<string>"))))
    # The difference of places hashes them once, so a text of many lines and many dropped ones stays linear.
    kept = F.expr("transform(array_except(sequence(0, size(__lines) - 1), __drop), i -> get(__lines, i))")
    text = F.when(F.size("__drop") == 0, F.col(f"`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    d = d.withColumn("__text", text)
    own = [F.col("__text").alias(c) if c == text_col else F.col(f"`{c}`")
           for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return d.select(*own, F.size("__lines").cast("long").alias("n_lines"),
                    F.size("__drop").cast("long").alias("n_dropped"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring_lines(docs, rungs=True, min_tokens=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, line_no, tokens FROM (
    SELECT doc_id, line_no, list_transform(regexp_split_to_array(trim(line, '{_SEPARATORS}'), '[\\x20\\x09\\x0B-\\x0D]+'),
        lambda t: CASE WHEN regexp_matches(t, '[0-9]|@|://') THEN '{VARIABLE}' ELSE t END) AS tokens
    FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)))
  WHERE tokens[1] <> ''
), keyed AS (
  SELECT *, len(tokens)::VARCHAR || ' ' || array_to_string(tokens[1:{DEPTH}], ' ') AS leaf FROM lines
), leaves AS (SELECT leaf FROM keyed GROUP BY leaf HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), found AS (SELECT * FROM keyed WHERE leaf IN (SELECT leaf FROM leaves)
), kinds AS (SELECT leaf, tokens, count(DISTINCT doc_id) AS n FROM found GROUP BY leaf, tokens
), placed AS (
  SELECT leaf, tokens, n, generate_subscripts(tokens, 1) - 1 AS place, unnest(tokens) AS token FROM kinds
), constant AS (
  SELECT leaf, place, token, len(bin(CAST(sum(n) // {MIN_DOCS} AS BIGINT))) - 1 AS rung FROM placed WHERE token <> '{VARIABLE}'
  GROUP BY leaf, place, token HAVING sum(n) >= {MIN_DOCS}
), parts AS (
  SELECT p.leaf, p.tokens, p.place, p.token, c.rung
  FROM placed p LEFT JOIN constant c ON p.leaf = c.leaf AND p.place = c.place AND p.token = c.token
), tried AS (
  SELECT leaf, tokens, 0 AS k FROM kinds UNION SELECT leaf, tokens, rung + 1 FROM parts WHERE rung IS NOT NULL AND place >= {DEPTH}
), shown AS (
  SELECT leaf, tokens, k, array_agg(CASE WHEN rung >= k OR place < {DEPTH} THEN token ELSE '{VARIABLE}' END ORDER BY place) AS t
  FROM parts JOIN tried USING (leaf, tokens) GROUP BY leaf, tokens, k
), steady AS (
  SELECT leaf, tokens, arg_max(array_to_string(t, ' '), k) AS template FROM shown
  WHERE len(list_filter(t, lambda x: x <> '{VARIABLE}')) >= {MIN_CONSTANT} * len(t) GROUP BY leaf, tokens
), occurrences AS (SELECT f.doc_id, f.line_no, s.template FROM found f JOIN steady s ON f.leaf = s.leaf AND f.tokens = s.tokens
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY template ORDER BY doc_id, line_no) AS k FROM occurrences
  WHERE template IN (SELECT template FROM occurrences GROUP BY template HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
), gone AS (SELECT doc_id, list(line_no) AS drops FROM numbered WHERE k > 1 GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(drops), 0)::BIGINT AS n_dropped,
       sha256(coalesce(CASE WHEN drops IS NULL THEN d.text ELSE array_to_string(list_filter(list_transform(
           string_split(d.text, chr(10)), lambda x, i: CASE WHEN list_contains(drops, i - 1) THEN NULL ELSE x END),
           lambda x: x IS NOT NULL), chr(10)) END, '')) AS kept_sha256
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id
"""
