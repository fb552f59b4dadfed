"""Secret scan: fixed patterns, and a log-likelihood ratio of two character Markov models.

Base spans come from three patterns. The method adds tokens (runs of 20 or more token characters outside base spans, with
two kinds of characters at least) that a first-order Markov model of random strings explains better than one of
ordinary identifiers. Both models are bigram counts over 68 character classes, trained from labelled samples: random
strings are the values of base spans, identifiers are the words of the same texts that no base span covers. The
sample is at most ``TRAIN_DOCS`` labelled documents (the least hashes of ``doc_id``). A uniform prior stands in where there
is little to learn from.

Places of matches come from the text between them: a text is split at the matches, and lengths are summed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# A run that is long enough is matched whole, and a shorter one holds no other match: the length is in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
#: Kinds in the order of the digest; the method's comes last.
KINDS = ("assign", "access", "hex", "markov")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"

#: Bound on the labelled documents that the models are trained on.
TRAIN_DOCS = 4000
CLASSES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Least log-likelihood ratio per bigram (nats) for a span, and bigrams that the uniform prior counts as.
LEAST_RATIO, PRIOR = 1.0, 2000.0


def _matches(text: str, pattern: str, least: int | None = None) -> F.Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches, in code points; ``value`` is group 1 if
    ``least`` asks for its length, else the match."""
    t, p = F.col(text), F.lit(pattern)
    found = F.regexp_extract_all(t, p, F.lit(0))
    values = F.regexp_extract_all(t, p, F.lit(1)) if least else found
    gaps = F.split(t, pattern)
    # a running sum: each entry starts after all gaps and matches before it
    parts = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), values,
                       lambda x, v: F.struct(x["g"].alias("g"), x["m"].alias("m"), v.alias("v")))
    parts = F.filter(parts, lambda x: x["m"].isNotNull())
    kind = "struct<at:bigint,out:array<struct<start:bigint,end:bigint,value:string>>>"
    run = F.aggregate(
        parts, F.expr(f"cast(named_struct('at', 0L, 'out', array()) AS {kind})"),
        lambda s, x: F.struct((s["at"] + x["g"] + x["m"]).alias("at"), F.concat(s["out"], F.array(F.struct(
            (s["at"] + x["g"]).alias("start"), (s["at"] + x["g"] + x["m"]).alias("end"), x["v"].alias("value")))).alias("out")),
        lambda s: s["out"])
    if least:
        run = F.filter(run, lambda x: F.length(x["value"]) >= least)
    none = F.expr("cast(array() AS array<struct<start:bigint,end:bigint,value:string>>)")
    return F.when(F.rlike(t, p), run).otherwise(none)


def _base(docs: DataFrame) -> DataFrame:
    of = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                     F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    for kind, pattern, least in (("assign", ASSIGN, ASSIGN_VALUE), ("access", ACCESS, None), ("hex", HEX, None)):
        of = of.withColumn(f"_{kind}", _matches("_text", pattern, least))
    return of


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> list[float]:
    """Log-likelihood ratio (random over identifier) of every bigram of classes; ``len(CLASSES) ** 2`` numbers."""
    ids = (labels.select(F.col("doc_id").cast("long").alias("_labelled")).where(F.col("_labelled").isNotNull()).distinct()
           .orderBy(F.xxhash64("_labelled"), "_labelled").limit(most))
    of = _base(docs.join(F.broadcast(ids), docs["doc_id"].cast("long") == ids["_labelled"], "left_semi"))
    spans = F.concat("_assign", "_access", "_hex")
    of = of.select("_text", spans.alias("_spans"))
    secret = of.select(F.explode_outer("_spans").alias("_s")).select(F.col("_s.value").alias("_t"), F.lit(1).alias("_random"))
    # words of the text with base spans blanked out: the value texts themselves are removed
    word = of.select(F.explode_outer(words(F.expr(
        "aggregate(_spans, _text, (t, s) -> replace(t, s.value, ' '))"))).alias("_t")).withColumn("_random", F.lit(0))
    bigrams = (secret.union(word).where("length(_t) > 1")
               .select("_random", F.explode(F.expr("transform(sequence(1, length(_t) - 1), i -> substring(_t, i, 2))")).alias("_b"))
               .groupBy("_random", "_b").agg(F.count("*").alias("_n")))
    size = len(CLASSES)
    place = {c: i for i, c in enumerate(CLASSES)}
    counts = [[PRIOR / size / size] * (size * size) for _ in range(2)]
    known = F.length(F.translate(F.col("_b"), CLASSES, "")) == 0
    for kind, b, n in bigrams.where(known).collect():  # at most 2 * 67^2 rows
        counts[kind][place[b[0]] * size + place[b[1]]] += n
    out = []
    for i in range(size):
        rows = [c[i * size:(i + 1) * size] for c in counts]
        sums = [sum(r) for r in rows]
        out += [math.log(r / sums[1]) - math.log(w / sums[0]) for w, r in zip(*rows)]
    return out


def scan(docs: DataFrame, model: list[float], least: float = LEAST_RATIO) -> DataFrame:
    """``row`` (all columns of docs), ``doc_id``, ``text`` and the arrays of spans by kind: ``assign``, ``access``, ``hex``, ``markov``.

    Null texts count as empty and hold nothing; repeated rows are scanned alike; columns of docs keep their names inside
    ``row``; an empty table gives no rows.
    """
    size = len(CLASSES)
    ratio = F.expr(f"cast(split('{','.join(f'{x:.6f}' for x in model)}', ',') AS array<double>)")
    of = _base(docs).withColumn("_token", _matches("_text", TOKEN)).withColumn("_model", F.when(F.size("_token") > 0, ratio))
    mean = ("aggregate(sequence(1, length(x.value) - 1), 0.0D, (s, i) -> s + _model["
            f"(instr('{CLASSES}', substring(x.value, i, 1)) - 1) * {size} + instr('{CLASSES}', substring(x.value, i + 1, 1)) - 1])"
            " / (length(x.value) - 1)")
    mixed = "(IF(x.value rlike '[a-z]', 1, 0) + IF(x.value rlike '[A-Z]', 1, 0) + IF(x.value rlike '[0-9]', 1, 0)) > 1"
    free = "NOT exists(concat(_assign, _access, _hex), b -> b.start < x.end AND b.end > x.start)"
    of = of.withColumn("_markov", F.expr(f"filter(_token, x -> {mixed} AND {free} AND {mean} >= {least})"))
    return of.select("row", "doc_id", F.col("_text").alias("text"), *(F.col(f"_{k}").alias(k) for k in KINDS))


def _listed(kinds: tuple[str, ...]) -> F.Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    spans = F.concat(*(F.expr(f"transform({k}, x -> struct(x.start AS start, {i} AS kind, x.end AS end))") for i, k in enumerate(kinds)))
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, hash of the base spans, all spans as text, number of spans the method added."""
    return scanned.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
                          F.sha2(_listed(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), _listed(KINDS).alias("spans"),
                          F.size(KINDS[3]).cast("long").alias("n_markov"))


def redact(docs: DataFrame, model: list[float], mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by a mark (overlapping spans by one), in the columns of docs; ``n_chars`` follows."""
    of = scan(docs, model).withColumn("_spans", F.sort_array(F.concat(*(
        F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in KINDS))))
    joined = F.expr(f"""
        aggregate(_spans, named_struct('at', 0L, 'out', ''), (s, x) -> named_struct('at', greatest(s.at, x.end), 'out',
            IF(x.start >= s.at, concat(s.out, substring(text, cast(s.at + 1 AS int), cast(x.start - s.at AS int)), '{mark}'), s.out)),
        s -> concat(s.out, substring(text, cast(s.at + 1 AS int))))""")
    text = F.when(F.size("_spans") > 0, joined).otherwise(F.col("row")["text"])
    of = of.select("row", text.alias("_new"))
    return of.select(*(F.col("_new").alias(c) if c == "text" else F.length("_new").cast("long").alias(c) if c == "n_chars"
                       else F.col("row")[c].alias(c) for c in docs.columns))
