"""Personal data: pattern spans plus information-theoretic sanitisation (DataFrame functions only).

Emails, IP addresses, card and phone numbers are found by patterns. Corpus co-occurrence then estimates how
strongly the words near such an entity reveal it: with n(e, t) documents in which term t stands near entity e
and n(t) documents that hold t at all, p(e | t) = n(e, t) / n(t), and the disclosure is log2(p(e | t) / p(e))
bits, which -log2 p(e) bounds. A term beyond ``MIN_DISCLOSURE`` with ``MIN_BITS``, or with ``BITS_SHARE`` of the bound
where an entity is too frequent for that many bits (a hot source's, or any in a small table), seen in at least two different contexts (so copies of one text prove
nothing), is masked in the documents that hold the entity: removed when it names the entity almost surely,
otherwise generalised.

Spans come from one scan per document: matches and the text between them give code-point positions. Only
entities and the terms near them are shuffled, as partial counts; n(t) is counted with a map-side combine and
only for candidate terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]

# The contract's patterns. Possessive loops and the start conditions only remove backtracking:
# a run of local-part characters or digits is entered at its start or where the previous match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    # Thirteen digits and more: a run of fewer has no later start with more, so only runs that fail the check leave.
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without the gate has no match; plain byte searches are cheaper than the pattern.
_GATES = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_SPAN = "array<struct<start:int,end:int,value:string>>"

NEAR_WORDS = 6        # words on either side of an entity that count as near
NEAR_CHARS = 160      # characters read on either side to find them
MIN_DISCLOSURE = 0.5  # p(entity | term)
MIN_BITS = 6.0        # log2(p(entity | term) / p(entity))
BITS_SHARE = 0.9      # share of -log2 p(entity) that counts in place of MIN_BITS where it is less
REMOVE_AT = 0.95      # p(entity | term) from which a term is removed rather than generalised
BROADCAST_ROWS = 50_000
BLOCK = 1024          # code points in a block of a text, see _blocks


def _running(values: str, merge: str) -> str:
    """SQL for running totals (or maxima) of an array: ``merge`` joins ``x`` with ``y``, the total a power of two back.

    The accumulator is the whole array, so n items take log2 n passes and nothing is copied per item.
    """
    return (f"aggregate(sequence(0, cast(ceil(log2(greatest(size({values}), 1))) AS int)), {values}, (a, j) -> "
            f"transform(a, (x, i) -> CASE WHEN i < shiftleft(1, j) THEN x ELSE {merge.replace('y', 'a[i - shiftleft(1, j)]')} END))")


def _spans(text: str, pattern: str) -> str:
    """SQL for the matches of ``pattern`` in column ``text`` with code-point positions, in reading order.

    A match ends at the running total of the gaps and matches up to it.
    """
    return (f"transform(transform(transform(array(struct(regexp_extract_all({text}, {pattern}, 0) AS m, split({text}, {pattern}, -1) AS g)),"
            " p -> struct(p.m AS m, transform(p.m, (m, i) -> length(p.g[i]) + length(m)) AS steps)),"
            f" p -> struct(p.m AS m, {_running('p.steps', 'x + y')} AS ends)),"
            " p -> transform(p.m, (m, i) -> named_struct('start', p.ends[i] - length(m), 'end', p.ends[i], 'value', m)))[0]")


def _blocks(text: str) -> str:
    """SQL for the text in blocks of code points, so that a piece is read without counting from the text's start."""
    return f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)"


def _piece(blocks: str, start: str, end: str) -> str:
    """SQL for the code points ``start`` to ``end`` (exclusive, or beyond the text) out of ``_blocks``."""
    first = f"cast(({start}) div {BLOCK} AS int)"
    return (f"CASE WHEN ({end}) > ({start}) THEN substring(array_join(slice({blocks}, {first} + 1, "
            f"cast((({end}) - 1) div {BLOCK} AS int) - {first} + 1), ''), ({start}) % {BLOCK} + 1, ({end}) - ({start})) ELSE '' END")


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn check: from the right every second digit doubled (9 taken off above 9), sum divisible by ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(13, 19) & _luhn(_digits(value))
    return n.between(9, 15)


def _checked(kind: str) -> Column:
    """The kind's valid spans, tagged with it."""
    return F.transform(F.filter(f"__p_{kind}", lambda x: _valid(kind, x["value"])), lambda x: F.struct(
        F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))


def find_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``base``: array of (kind, start, end, value), by kind as listed, then start.

    Null and empty texts have no spans. Matches that fail their check are dropped without a retry.
    """
    d = docs.withColumn("__p_text", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    none = F.array().cast(_SPAN)
    for kind in KINDS:
        found = F.expr(_spans("__p_text", _literal(PATTERNS[kind])))
        if kind == "card":
            gate = F.col("__p_text").rlike("[0-9][\\x20-]?[0-9]")
        else:
            gate = F.contains("__p_text", F.lit(_GATES[kind]))
        if kind == "ip":
            gate = gate & F.col("__p_text").rlike(r"[0-9]\.[0-9]")
        d = d.withColumn(f"__p_{kind}", F.when(gate, found).otherwise(none))
    parts = [_checked(kind) for kind in KINDS]
    own = [F.col(f"`{c}`") for c in docs.columns if c != "base"]
    # One row each: the generator keeps later steps from repeating the pattern work.
    return d.select(*own, F.inline(F.array(F.struct(F.concat(*parts).alias("base")))))


def _lower(text: Column) -> Column:
    """Lower case, character by character: the dotted capital I, the only one that lower() makes two of, becomes i."""
    return F.lower(F.translate(text, "\u0130", "i"))


def _term_words(text: Column) -> Column:
    """Lower-cased alphabetic words of four characters or more."""
    return F.filter(F.split(_lower(text), r"[^\p{L}]+", -1), lambda w: F.length(w) >= 4)


def _checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """A checkpointed table with its row count; broadcast only if the count is within ``rows``."""
    df = df.checkpoint(eager=True)
    n = df.count()
    return (F.broadcast(df) if n <= rows else df), n


def revealing_terms(found: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_disclosure: float = MIN_DISCLOSURE, min_bits: float = MIN_BITS) -> DataFrame:
    """(value, term, p): terms that reveal an entity, from co-occurrence over all of ``found``.

    Null and empty texts hold no entity and no term. Rows of one id count as one document near an entity; a null id is one
    document. Repeated rows repeat their context, so alone they reveal nothing; they do count in n(t) and n(e). An empty table
    has no terms. The contexts of a text are read in one pass, so a very long text costs in proportion to its length and spans.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # Context of a span: the words next to it, without the span's own characters.
    around = F.expr("transform(array({b}), bs -> transform(base, x -> struct(x.value AS value, {l} AS before, {r} AS after)))[0]".format(
        b=_blocks("__t"), l=_piece("bs", f"greatest(x.start - {NEAR_CHARS}, 0)", "x.start"),
        r=_piece("bs", "x.end", f"x.end + {NEAR_CHARS}")))
    spans = (found.where(F.size("base") > 0).select(F.col(f"`{id_col}`").alias("__id"), text.alias("__t"), "base")
             .select("__id", F.inline(around)))
    before, after = F.col("before"), F.col("after")
    near = spans.select(
        "__id", "value", F.xxhash64(before, after).alias("context"),
        F.array_distinct(F.concat(F.slice(F.reverse(_term_words(before)), 1, NEAR_WORDS),
                                  F.slice(_term_words(after), 1, NEAR_WORDS))).alias("terms"))
    beside = near.select("__id", "value", "context", F.explode("terms").alias("term"))
    pairs = (beside.groupBy("value", "term", "__id").agg(F.min("context").alias("lo"), F.max("context").alias("hi"))
             .groupBy("value", "term").agg(F.count("*").alias("n_et"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
             .where("n_et >= 2 AND lo <> hi").select("value", "term", "n_et"))
    # A term stands in at least as many documents as it stands in near any entity, so p can't exceed n_et over those:
    # common words leave here, before the whole corpus is counted, and no pair that could pass does.
    anywhere = beside.groupBy("term", "__id").agg(F.lit(1).alias("one")).groupBy("term").agg(F.count("*").alias("n_near"))
    pairs = pairs.join(anywhere, "term").where(F.col("n_et") >= min_disclosure * F.col("n_near")).select("value", "term", "n_et")
    pairs, n_pairs = _checked_broadcast(pairs)
    if n_pairs == 0:
        return pairs.select("value", "term", F.lit(0.0).alias("p"))
    candidates = pairs.select("term").distinct()
    candidates = F.broadcast(candidates) if n_pairs <= BROADCAST_ROWS else candidates
    in_docs = found.select(F.explode(F.array_distinct(_term_words(text))).alias("term"))
    totals = in_docs.join(candidates, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    entity_docs = (found.where(F.size("base") > 0)
                   .select(F.explode(F.array_distinct(F.transform("base", lambda x: x["value"]))).alias("value"))
                   .groupBy("value").agg(F.count("*").alias("n_e")))
    n_docs = found.count()
    scored = (pairs.join(totals, "term").join(entity_docs, "value")
              .withColumn("p", F.col("n_et") / F.col("n_t"))
              .withColumn("bits", F.log2(F.col("p") * F.lit(float(n_docs)) / F.col("n_e")))
              .withColumn("bound", F.log2(F.lit(float(n_docs)) / F.col("n_e"))))
    enough = (F.col("bits") > 0) & (F.col("bits") >= F.least(F.lit(min_bits), BITS_SHARE * F.col("bound")))
    return scored.where((F.col("p") >= min_disclosure) & enough).select("value", "term", "p")


# Hits that no base span overlaps. In order of where a base span starts and a hit ends, a hit overlaps if the farthest end of
# the base spans so far lies behind its start; at one position hits come first.
_CLEAR = f"""transform(transform(transform(array(sort_array(concat(
        transform(base, b -> struct(b.start AS at, 1 AS is_base, b.end AS reach, 0 AS start, '' AS value)),
        transform(__hits, h -> struct(h.end AS at, 0 AS is_base, 0 AS reach, h.start AS start, h.value AS value))))),
    o -> struct(o AS o, transform(o, e -> e.reach) AS r)),
    p -> struct(p.o AS o, {_running('p.r', 'greatest(x, y)')} AS r)),
    p -> transform(filter(p.o, (e, i) -> e.is_base = 0 AND p.r[i] <= e.start),
        e -> named_struct('start', e.start, 'end', e.at, 'value', e.value)))[0]"""


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus ``base`` and ``terms``: arrays of (kind, start, end, value); ``terms`` has kind ``term``
    (generalise) or ``term_removed`` (remove) and never overlaps a base span.

    Null and empty texts have no spans. Repeated rows are treated alike; rows of one id share the terms of that id's entities, as
    do rows without id. An empty table stays empty. Other columns stay, save any named ``base`` or ``terms``, which are
    replaced. A very long text costs in proportion to its length, and spans times their log2.
    """
    found = find_base(docs, text_col)
    flagged, n = _checked_broadcast(revealing_terms(found, id_col, text_col))
    if n == 0:
        return found.withColumn("terms", F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>"))
    # One row an entity; a document keeps only those of its entities' terms that it holds, so that a frequent entity with
    # many terms does not lengthen every document's list.
    flagged = flagged.groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("term", "p"))).alias("ps"))
    flagged = F.broadcast(flagged) if n <= BROADCAST_ROWS else flagged
    held = F.array_intersect(F.map_keys("ps"), "words")
    of_doc = (found.where(F.size("base") > 0)
              .select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__t"),
                      F.explode(F.array_distinct(F.transform("base", lambda x: x["value"]))).alias("value"))
              .join(flagged, "value").select("__id", "ps", _term_words(F.col("__t")).alias("words"))
              .select("__id", F.explode(F.transform(held, lambda t: F.struct(
                  t.alias("term"), F.element_at("ps", t).alias("p")))).alias("x"))
              .groupBy(F.col("__id").alias("__pii_doc")).agg(F.collect_set("x").alias("__flagged")))
    of_doc, _ = _checked_broadcast(of_doc)
    d = found.join(of_doc, found[id_col].eqNullSafe(of_doc["__pii_doc"]), "left").drop("__pii_doc")
    d = (d.withColumn("__low", _lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
         .withColumn("__pat", F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(
             F.array_sort(F.array_distinct(F.transform("__flagged", lambda x: x["term"]))), "|"),
             F.lit(r")(?!\p{L})"))))
    hits = F.when(F.col("__flagged").isNotNull(), F.expr(_spans("__low", "__pat"))).otherwise(F.array().cast(_SPAN))
    d = d.withColumn("__hits", hits)
    d = d.withColumn("__hits", F.expr(_CLEAR))
    kind = lambda h: F.when(F.exists("__flagged", lambda f: (f["term"] == h["value"]) & (f["p"] >= REMOVE_AT)),
                            F.lit("term_removed")).otherwise(F.lit("term"))
    terms = F.transform("__hits", lambda h: F.struct(kind(h).alias("kind"), h["start"].alias("start"),
                                                  h["end"].alias("end"), h["value"].alias("value")))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("base", "terms")]
    return d.select(*own, "base", F.coalesce(terms, F.array().cast(
        "array<struct<kind:string,start:int,end:int,value:string>>")).alias("terms"))


def sanitised_text(text: str = "text") -> Column:
    """The text with every span replaced: ``<EMAIL>`` and so on, ``<TERM>`` if generalised, nothing if removed.

    Overlapping spans are replaced as one, under the name of the first. A null text becomes empty. The time grows with the
    text and its spans: pieces are read from blocks and joined once.
    """
    keep = _piece("p.bs", "z.before", "z.s.start")
    rest = _piece("p.bs", "coalesce(try_element_at(p.r, -1), 0)", f"length(coalesce(`{text}`, ''))")
    return F.expr(f"""
        transform(transform(transform(array(sort_array(transform(concat(base, terms), x -> struct(x.start, x.end, x.kind)))),
            o -> struct(o AS o, transform(o, e -> e.end) AS r)),
            p -> struct(p.o AS o, {_running('p.r', 'greatest(x, y)')} AS r, {_blocks(f"coalesce(`{text}`, '')")} AS bs)),
        p -> concat(array_join(transform(filter(
                transform(p.o, (s, i) -> struct(s AS s, CASE WHEN i = 0 THEN 0 ELSE p.r[i - 1] END AS before)),
                z -> z.s.start >= z.before),
            z -> concat({keep}, CASE WHEN z.s.kind = 'term_removed' THEN '' ELSE concat('<', upper(z.s.kind), '>') END)), ''),
            {rest}))[0]""")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = find_spans(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = _joined(F.col("base"))
    return d.select("doc_id", *[count(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"),
                    _joined(F.concat("base", "terms")).alias("spans"))
