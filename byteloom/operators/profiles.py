"""Statistical fingerprints of byte streams (12 features), their similarity, and ranking against known domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from byteloom.operators.graph import CHUNK, with_neighbours

SIZE, WINDOW = 12, 8
#: The vector assumed for a domain, by keywords in its tag, the first that fits; the last is for other tags.
DOMAINS: list[tuple[tuple[str, ...], tuple[float, ...]]] = [
    (("audio", "speech", "music"), (0.85, 0.3, 0.2, 0.3, 0.25, 0.2, 0.1, 0.05, 0.04, 0.03, 0.03, 0.25)),
    (("arith", "numeric", "sequence"), (0.3, 0.8, 0.6, 0.7, 0.2, 0.05, 0.025, 0.01, 0.005, 0.005, 0.005, 0.1)),
    (("repet", "zeros", "zero"), (0.05, 0.95, 0.9, 0.98, 0.01, 0.004, 0.002, 0.001, 0.001, 0.001, 0.001, 0.02)),
    (("random", "binary", "rand"), (0.99, 0.05, 0.05, 0.125, 0.125, 0.125, 0.125, 0.125, 0.125, 0.125, 0.125, 0.5)),
    (("",), (0.5, 0.1, 0.1, 0.125, 0.125, 0.125, 0.125, 0.125, 0.125, 0.125, 0.125, 0.5)),
]
#: The tags that a search over known domains asks for.
SEARCHED = ["audio", "arith", "numeric", "sequence", "repetitive", "zeros", "random", "binary", ""]


def fingerprints(bytes_: DataFrame) -> DataFrame:
    """(stream_id, f0..f11): entropy/8, share of equal neighbouring absolute steps, share of steps seen among the eight before, histogram of absolute steps in eight
    bins, mean absolute step/255. A stream of one byte has only zeros."""
    counts = bytes_.groupBy("stream_id", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("stream_id")
    p = F.col("c") / F.sum("c").over(w)
    entropy = counts.withColumn("h", -p * F.log2(p)).groupBy("stream_id").agg((F.sum("h") / 8).alias("f0"))
    # a pair stands at its second byte; the eight pairs before a chunk take nine bytes
    w = Window.partitionBy("stream_id", "c").orderBy("pos")
    d = with_neighbours(bytes_, WINDOW + 1, 0, CHUNK).withColumn("d", F.abs(F.col("v") - F.lag("v").over(w)))
    same = [F.coalesce(F.lag("d", k).over(w) == F.col("d"), F.lit(False)) for k in range(1, WINDOW + 1)]
    seen = d.withColumns({"again": same[0], "recent": reduce(lambda x, y: x | y, same)}).where("own and d is not null").withColumn("pos", F.col("pos") - 1)
    m = F.count("*")
    late = F.sum(((F.col("pos") >= WINDOW) & F.col("recent")).cast("long"))
    features = [F.coalesce(F.sum(F.col("again").cast("long")) / F.nullif(m - 1, F.lit(0)), F.lit(0.0)).alias("f1"), F.coalesce(late / F.nullif(F.greatest(m - WINDOW, F.lit(0)), F.lit(0)), F.lit(0.0)).alias("f2")]
    features += [(F.sum((F.least(F.floor(F.col("d") / 32), F.lit(7)) == i).cast("long")) / m).alias(f"f{3 + i}") for i in range(8)]
    features += [(F.sum("d") / m / 255.0).alias("f11")]
    out = entropy.join(seen.groupBy("stream_id").agg(*features), "stream_id", "left").na.fill(0.0)
    return out.select("stream_id", *(f"f{i}" for i in range(SIZE)))


def vector(prefix: str = "f") -> Column:
    return F.array(*(F.col(f"{prefix}{i}") for i in range(SIZE)))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def assumed_class(tag: Column) -> Column:
    """The place in DOMAINS of the vector assumed for a domain tag."""
    low, out = F.lower(F.coalesce(tag, F.lit(""))), F.lit(len(DOMAINS) - 1)
    for i, (words, _) in reversed(list(enumerate(DOMAINS[:-1]))):
        out = F.when(reduce(lambda x, y: x | y, (low.contains(x) for x in words)), i).otherwise(out)
    return out


def by_class(samples: DataFrame) -> DataFrame:
    """The samples with their likeness to each assumed vector: (..., class, score), as many rows a sample as there are vectors."""
    scores = F.array(*(cosine(vector(), F.array(*map(F.lit, v))) for _, v in DOMAINS))
    return samples.select("stream_id", F.posexplode(scores).alias("class", "score"))


def ranked(samples: DataFrame, index: DataFrame, domains: list[str] | None = None, salts: int = 16) -> DataFrame:
    """Each sample (stream_id, f0..f11) against each snapshot (id, domain): (stream_id, id, domain, score, rank); an id counts once, under its first domain by name.
    Where the index has a column `readable`, snapshots that aren't score 0. Rows join by the class of vector and a salt, so neither side meets the other in one task."""
    known = index if domains is None else index.where(F.col("domain").isin(domains))
    ok = F.coalesce(F.col("readable"), F.lit(False)) if "readable" in index.columns else F.lit(True)
    known = known.withColumn("ok", ok).groupBy("id").agg(F.min(F.struct("domain", "ok")).alias("k")).select("id", "k.domain", "k.ok").withColumns({"class": assumed_class(F.col("domain")), "salt": F.pmod(F.xxhash64("id"), F.lit(salts))})
    dealt = by_class(samples).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    scored = dealt.join(known, ["class", "salt"]).select("stream_id", "id", "domain", F.when(F.col("ok"), F.col("score")).otherwise(0.0).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("score"), "id")))


def best(samples: DataFrame, index: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """The first of each sample's ranking: (stream_id, id, domain, score), by the first snapshot of each class of vector, so the whole index never meets the samples."""
    known = index if domains is None else index.where(F.col("domain").isin(domains))
    if "readable" in index.columns:
        known = known.where("readable")
    once = known.groupBy("id").agg(F.min("domain").alias("domain"))
    firsts = once.groupBy(assumed_class(F.col("domain")).alias("class")).agg(F.min(F.struct("id", "domain")).alias("k"))
    found = by_class(samples).join(F.broadcast(firsts), "class")  # a row a vector
    return found.groupBy("stream_id").agg(F.min(F.struct((-F.col("score")).alias("less"), "k")).alias("x")).select("stream_id", "x.k.id", "x.k.domain", (-F.col("x.less")).alias("score"))


def responses(requests: DataFrame, index: DataFrame) -> DataFrame:
    """(stream_id, status, body) of requests (stream_id, method, path, payload): a health check, and the snapshot that fits a payload best, as JSON. A null payload is empty; other paths are not found."""
    from byteloom.sources.streams import exploded

    asked = requests.where("path = '/select' and upper(method) = 'POST' and octet_length(payload) > 0")
    samples = fingerprints(exploded(asked, F.col("stream_id"), F.col("payload")))
    found = best(samples, index, SEARCHED)
    escaped = F.replace(F.replace(F.col("domain"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    body = F.concat(F.lit('{"snapshot_id":"'), F.col("id"), F.format_string('","score":%.4f,"domain":"', "score"), escaped, F.lit('"}'))
    r = requests.withColumn("stream_id", F.col("stream_id").cast("string")).join(found.select("stream_id", body.alias("found")), "stream_id", "left")
    answer = lambda status, text: F.struct(F.lit(status).alias("status"), text.alias("body"))
    error = lambda status, name: answer(status, F.lit(f'{{"error":"{name}"}}'))
    select = F.when(F.upper("method") != "POST", error(405, "method_not_allowed")).when(F.coalesce(F.octet_length("payload"), F.lit(0)) == 0, error(400, "empty_body")).when(F.col("found").isNull(), error(404, "no_snapshots_available")).otherwise(answer(200, F.col("found")))
    got = F.when(F.col("path") == "/health", answer(200, F.lit('{"status":"ok"}'))).when(F.col("path") == "/select", select).otherwise(error(404, "not_found"))
    return r.select("stream_id", got.alias("r")).select("stream_id", "r.status", "r.body")


def known_domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"domain-{i}", t) for i, t in enumerate(SEARCHED)], "id string, domain string")
