"""Populations of (a, b, operator) rules: fitness, selection, crossover, mutation, adaptation, history, and the search loop.

A population is a table of rules (chrom_id, rule_no, a, b, op_id, operand). A corpus counts through its digrams alone, so the fitness of a whole population is one join.
Draws come from hashes of seeds and keys: a generation can be made again after a lost executor, and on any layout of the data.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from threading import Event, Thread

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from byteloom.functions import algebra

PENALTY, LEAST_CORPUS = 0.001, 256


@dataclass(frozen=True)
class Config:
    population: int = 100
    generations: int = 1000
    window: int = 65536
    elite: int = 2
    tournament: int = 5
    rule_mutation: float = 0.05
    chromosome_mutation: float = 0.02
    most_rules: int = 1024
    first_rules: int = 16
    crossover: str = "OPERATOR_AWARE"

    def __post_init__(self):
        if self.population < 2 or self.window < LEAST_CORPUS or not 0 <= self.elite <= self.population or self.tournament < 1 or self.most_rules < 1:
            raise ValueError("a setting is out of bounds")


#: Fixed values of the presets.
DEFAULT = Config()
FAST = Config(population=20, generations=100, window=8192, elite=1, tournament=3, rule_mutation=0.1, chromosome_mutation=0.05, most_rules=256)
THOROUGH = Config(population=500, window=262144, elite=5, tournament=10, rule_mutation=0.03, chromosome_mutation=0.01, most_rules=2048)


def draw(seed: int, *keys) -> Column:
    """Uniform in [0, 1), the same for the same seed and keys."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def random_population(spark: SparkSession, size: int, rules: int, seed: int = 0) -> DataFrame:
    """Distinct random pairs with their cheapest operator."""
    rows = spark.range(size).select(F.format_string("c%04d", "id").alias("chrom_id"), F.explode(F.sequence(F.lit(0), F.lit(rules - 1))).alias("k"))
    pairs = rows.select("chrom_id", "k", F.floor(draw(seed, "chrom_id", "k", F.lit("a")) * 256).cast("int").alias("a"), F.floor(draw(seed, "chrom_id", "k", F.lit("b")) * 256).cast("int").alias("b"))
    return numbered(pairs.groupBy("chrom_id", "a", "b").agg(F.min("k").alias("k")), "k").withColumn("o", algebra.cheapest(F.col("a"), F.col("b"))).select("chrom_id", "rule_no", "a", "b", "o.op_id", "o.operand")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("chrom_id").orderBy(*order, "a", "b")
    return rows.withColumn("rule_no", (F.row_number().over(w) - 1).cast("int"))


def from_edges(edge_rows: DataFrame, chrom_id: str, k: int) -> DataFrame:
    """A chromosome of the k heaviest edges of a stream's graph."""
    w = Window.orderBy(F.desc("weight"), "a", "b")
    top = edge_rows.orderBy(F.desc("weight"), "a", "b").limit(k)
    return top.select(F.lit(chrom_id).alias("chrom_id"), (F.row_number().over(w) - 1).cast("int").alias("rule_no"), "a", "b", "op_id", "operand")


def validity(rules: DataFrame) -> DataFrame:
    """(chrom_id, rules, valid): whether every rule's operator takes a to b."""
    return rules.groupBy("chrom_id").agg(F.count("*").alias("rules"), F.bool_and(F.coalesce(algebra.applied(F.col("op_id"), F.col("operand"), F.col("a")) == F.col("b"), F.lit(False))).alias("valid"))


def repaired(rules: DataFrame) -> DataFrame:
    """Rules whose operator doesn't take a to b get the cheapest one that does."""
    ok = F.coalesce(algebra.applied(F.col("op_id"), F.col("operand"), F.col("a")) == F.col("b"), F.lit(False))
    best = algebra.cheapest(F.col("a"), F.col("b"))
    return rules.withColumns({"ok": ok, "best": best}).select("chrom_id", "rule_no", "a", "b", F.when(F.col("ok"), F.col("op_id")).otherwise(F.col("best.op_id")).alias("op_id"), F.when(F.col("ok"), F.col("operand")).otherwise(F.col("best.operand")).alias("operand"))


def fitness(rules: DataFrame, counted: DataFrame, n: int) -> DataFrame:
    """(chrom_id, n_rules, encoded_bytes, fitness) on a corpus of n bytes given by its digrams (a, b, freq), without cycles; a rule that costs no more than the cheapest operator takes its place.

    A chromosome with an operator that the container can't name scores 0, as does one that gains nothing."""
    base = counted.select("a", "b", "freq", (algebra.cheapest(F.col("a"), F.col("b"))["cost"] < algebra.WORTH_BELOW).cast("int").alias("hit"))
    saved = base.agg(F.sum(F.col("freq") * F.col("hit")).alias("saved"))
    cost = F.when(F.col("op_id").between(10, 13), 5).when(F.col("op_id").between(8, 9), 8).otherwise(13)
    own = rules.select("chrom_id", "a", "b", "op_id", cost.alias("cost"))
    per = own.join(base.where("hit = 0"), ["a", "b"], "left").groupBy("chrom_id").agg(F.count("*").alias("n_rules"), F.sum(F.when(F.col("cost") < algebra.WORTH_BELOW, F.coalesce("freq", F.lit(0))).otherwise(0)).alias("more"), F.max((~F.col("op_id").between(0, 13)).cast("int")).alias("unknown"))
    j = per.withColumn("__one", F.lit(1)).join(saved.withColumn("__one", F.lit(1)), "__one")
    bits = 9 * F.lit(n) - 2 * (F.coalesce("saved", F.lit(0)) + F.col("more"))
    size = 9 + F.ceil(bits / 8)
    value = F.when(F.col("unknown") == 1, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - size / F.lit(float(n)) - PENALTY * F.col("n_rules")))
    return j.select("chrom_id", "n_rules", size.cast("long").alias("encoded_bytes"), value.alias("fitness"))


def batch_fitness(scored: DataFrame) -> DataFrame:
    """Mean over corpora weighted by their bytes, of rows (chrom_id, n, fitness)."""
    return scored.groupBy("chrom_id").agg((F.sum(F.col("fitness") * F.col("n")) / F.sum("n")).alias("fitness"))


def population_statistics(scored: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: best and mean fitness, population variance, size, distinct operators."""
    ops = rules.agg(F.countDistinct("op_id", "operand").alias("unique_operators")).withColumn("__one", F.lit(1))
    s = scored.agg(F.max("fitness").alias("best_fitness"), F.avg("fitness").alias("avg_fitness"), F.var_pop("fitness").alias("variance"), F.count("*").alias("population_size")).withColumn("__one", F.lit(1))
    return s.join(ops, "__one").drop("__one")


# -- selection


def elite(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("fitness"), "chrom_id").limit(k)


def elite_then(scored: DataFrame, count: int, k: int, size: int, seed: int = 0) -> DataFrame:
    """(slot, chrom_id): the k fittest (at most as many as are asked for, or there are), and tournaments for the slots that are left."""
    first = elite(scored, min(k, count)).select(F.lit(1).alias("of"), F.struct(-F.col("fitness"), "chrom_id").alias("key"), "chrom_id")
    first = first.select((F.row_number().over(Window.partitionBy("of").orderBy("key")) - 1).cast("long").alias("slot"), "chrom_id")
    drawn = tournament(scored, count, size, seed).join(first.select("slot"), "slot", "left_anti")
    return first.unionByName(drawn)


def dominating(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of left whose fitness is strictly higher than that of right's row of the same key."""
    return left.join(right.select(on, F.col("fitness").alias("other_fitness")), on).where(F.col("fitness") > F.col("other_fitness")).drop("other_fitness")


def tournament(scored: DataFrame, count: int, size: int, seed: int = 0) -> DataFrame:
    """(slot, chrom_id): of `size` draws from the population the fittest, the first of equals."""
    spark = scored.sparkSession
    w = Window.orderBy("chrom_id")
    people = scored.select("chrom_id", "fitness", (F.row_number().over(w) - 1).alias("i"))
    n = people.count()
    draws = spark.range(count).select(F.col("id").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("t")).withColumn("i", F.floor(draw(seed, "slot", "t") * n).cast("int"))
    best = Window.partitionBy("slot").orderBy(F.desc("fitness"), "t")
    return draws.join(people, "i").withColumn("r", F.row_number().over(best)).where("r = 1").select("slot", "chrom_id")


def rank_selection(scored: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """(slot, chrom_id): draws with weights 1, 2, ... from the fittest down, so the least fit are drawn most, as the format of this selection has it. The weight drawn is the
    triangular root of the draw, so slots join their chromosome by it alone."""
    people = scored.select("chrom_id", F.row_number().over(Window.orderBy(F.desc("fitness"), "chrom_id")).cast("long").alias("w"))
    n = people.count()
    at = F.floor(draw(seed, "id") * (n * (n + 1) / 2)).cast("long")
    root = F.floor((F.sqrt(8.0 * F.col("at") + 1) + 1) / 2).cast("long")
    below = lambda w: (w * (w - 1) / 2).cast("long")
    draws = scored.sparkSession.range(count).select(F.col("id").alias("slot"), at.alias("at")).withColumn("w", root)
    w = F.when(below(F.col("w")) > F.col("at"), F.col("w") - 1).when(below(F.col("w") + 1) <= F.col("at"), F.col("w") + 1).otherwise(F.col("w"))  # where the root was rounded
    return draws.withColumn("w", w).join(people, "w").select("slot", "chrom_id")


# -- variation


def crossed(left: DataFrame, right: DataFrame, kind: str = "OPERATOR_AWARE", seed: int = 0) -> DataFrame:
    """Children of pairs: rules of the first parent and of the second, chrom_id naming the pair in both. OPERATOR_AWARE merges by (a, b): of shared pairs the cheaper operator, others with probability 0.7."""
    if kind not in ("SINGLE_POINT", "TWO_POINT", "UNIFORM", "OPERATOR_AWARE"):
        raise ValueError(f"unknown crossover {kind}")
    cost = lambda c: F.when(c.between(10, 13), 5).when(c.between(8, 9), 8).otherwise(13)
    if kind == "OPERATOR_AWARE":
        x = left.select("chrom_id", "a", "b", F.struct("op_id", "operand").alias("x"))
        y = right.select("chrom_id", "a", "b", F.struct("op_id", "operand").alias("y"))
        j = x.join(y, ["chrom_id", "a", "b"], "full")
        both = F.col("x").isNotNull() & F.col("y").isNotNull()
        kept = j.where(both | (draw(seed, "chrom_id", "a", "b") < 0.7))
        taken = F.when(both, F.when(cost(F.col("x.op_id")) <= cost(F.col("y.op_id")), F.col("x")).otherwise(F.col("y"))).otherwise(F.coalesce("x", "y"))
        return numbered(kept.select("chrom_id", "a", "b", taken.alias("o")).select("chrom_id", "a", "b", "o.*")).select("chrom_id", "rule_no", "a", "b", "op_id", "operand")
    sizes = left.groupBy("chrom_id").agg(F.count("*").alias("n"))
    cut = F.floor(draw(seed, "chrom_id", F.lit("p")) * F.col("n"))
    second = F.floor(draw(seed, "chrom_id", F.lit("q")) * F.col("n"))
    first = {"SINGLE_POINT": F.col("rule_no") < cut, "TWO_POINT": ~F.col("rule_no").between(F.least(cut, second), F.greatest(cut, second) - 1), "UNIFORM": draw(seed, "chrom_id", "rule_no") < 0.5}[kind]
    take = lambda rules, test: rules.join(sizes, "chrom_id").where(test).drop("n")
    rows = take(left, first).unionByName(take(right, ~first))
    one = Window.partitionBy("chrom_id", "a", "b").orderBy("rule_no", "op_id", "operand")
    return numbered(rows.withColumn("r", F.row_number().over(one)).where("r = 1").drop("r", "rule_no")).select("chrom_id", "rule_no", "a", "b", "op_id", "operand")


def mutated(rules: DataFrame, rule_probability: float, most_rules: int, seed: int = 0, chromosome_probability: float | None = None) -> DataFrame:
    """Three independent changes, then the cut to the most rules allowed. Each rule takes, with the rule probability, the cheapest operator of its pair; a chromosome below the
    most rules gains a random new pair with the chromosome probability (by default the rule probability); one of more than one rule loses one with half the rule probability."""
    adding = rule_probability if chromosome_probability is None else chromosome_probability
    best = algebra.cheapest(F.col("a"), F.col("b"))
    swap = draw(seed, "chrom_id", "rule_no", F.lit("swap")) < rule_probability
    kept = rules.withColumn("o", F.when(swap, best)).select("chrom_id", "rule_no", "a", "b", F.coalesce("o.op_id", "op_id").alias("op_id"), F.coalesce("o.operand", "operand").alias("operand"))
    sizes = rules.groupBy("chrom_id").agg(F.count("*").alias("n"))
    new = sizes.where((draw(seed, "chrom_id", F.lit("add")) < adding) & (F.col("n") < most_rules))
    new = new.select("chrom_id", F.lit(None).cast("int").alias("rule_no"), *(F.floor(draw(seed, "chrom_id", F.lit(f"new{x}")) * 256).cast("int").alias(x) for x in "ab")).withColumn("o", best).select("chrom_id", "rule_no", "a", "b", "o.op_id", "o.operand")
    new = new.join(rules.select("chrom_id", "a", "b"), ["chrom_id", "a", "b"], "left_anti").select(*kept.columns)
    # the added rule stands last, and may be the one that goes
    w = Window.partitionBy("chrom_id")
    both = kept.unionByName(new).withColumns({"at": F.row_number().over(w.orderBy(F.col("rule_no").asc_nulls_last())) - 1, "n": F.count("*").over(w)})
    gone = (draw(seed, "chrom_id", F.lit("drop")) < rule_probability / 2) & (F.col("n") > 1) & (F.col("at") == F.floor(draw(seed, "chrom_id", F.lit("which")) * F.col("n")))
    left = both.where(~gone).withColumn("rule_no", (F.row_number().over(w.orderBy("at")) - 1).cast("int"))
    return left.where(F.col("rule_no") < most_rules).select("chrom_id", "rule_no", "a", "b", "op_id", "operand")


# -- history


def convergence(history: DataFrame, frame: int = 100) -> DataFrame:
    """Adds the slope of best_fitness from the first to the last of the last `frame` generations, 0 at the first."""
    w = Window.orderBy("generation").rowsBetween(-(frame - 1), 0)
    n = F.count("*").over(w)
    return history.withColumn("convergence_rate", F.when(n < 2, 0.0).otherwise((F.col("best_fitness") - F.first("best_fitness").over(w)) / (n - 1)))


def converged(history: DataFrame, frame: int = 500, least: float = 1e-4) -> DataFrame:
    """One row: whether there are `frame` generations and none of the steps within the last of them improves by `least`."""
    w = Window.orderBy("generation")
    d = history.select("generation", (F.col("best_fitness") - F.lag("best_fitness").over(w)).alias("gain"), F.row_number().over(Window.orderBy(F.desc("generation"))).alias("r"))
    return d.agg((F.count("*") >= frame).alias("enough"), F.coalesce(F.bool_and(F.when(F.col("r") < frame, F.coalesce(F.col("gain") < least, F.lit(True))).otherwise(True)), F.lit(True)).alias("flat")).select((F.col("enough") & F.col("flat")).alias("converged"))


def fitness_histogram(history: DataFrame) -> DataFrame:
    return history.groupBy(F.least(F.lit(9), F.greatest(F.lit(0), (F.col("best_fitness") * 10).cast("int"))).alias("bin")).agg(F.count("*").alias("n"))


def report(history: DataFrame) -> DataFrame:
    """One row: generations, start, end, peak and the first generation that reached it."""
    return history.agg(F.count("*").alias("generations"), F.min_by("best_fitness", "generation").alias("start_fitness"), F.max_by("best_fitness", "generation").alias("end_fitness"), F.max("best_fitness").alias("peak_fitness"), F.min_by("generation", F.struct(-F.col("best_fitness"), F.col("generation"))).alias("peak_generation"))


#: The marks of a sparkline, lowest first, and the parts of a run that it shows.
MARKS, PARTS = "▁▂▃▄▅▆▇█", 20


def sparkline(history: DataFrame) -> DataFrame:
    """One row (line, least, most): the best fitness of every n-th generation, n being a twentieth of the run, as marks between the least and the most; nothing for no rows."""
    ends = history.agg(F.count("*").alias("n"), F.min("best_fitness").alias("least"), F.max("best_fitness").alias("most")).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / PARTS)))
    rows = history.select(F.lit(1).alias("run"), "generation", "best_fitness").withColumn("i", F.row_number().over(Window.partitionBy("run").orderBy("generation")) - 1)
    span = F.col("most") - F.col("least")
    level = F.when(span < 1e-9, 3).otherwise(F.least(F.lit(len(MARKS) - 1), ((F.col("best_fitness") - F.col("least")) / span * (len(MARKS) - 1)).cast("int")))
    shown = rows.join(F.broadcast(ends), F.col("i") % F.col("step") == 0).withColumn("mark", F.substring(F.lit(MARKS), level + 1, F.lit(1)))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "mark"))), lambda x: x["mark"]), "")
    return shown.agg(line.alias("line"), F.first("least").alias("least"), F.first("most").alias("most")).where("least is not null")


#: The columns of a generation log and their forms.
LOG = {"generation": "%d", "timestamp_ms": "%d", "elapsed_ms": "%d", "best_fitness": "%.6f", "avg_fitness": "%.6f", "variance": "%.6f", "population_size": "%d", "unique_operators": "%d", "rule_count": "%d", "corpus_bytes": "%d", "convergence_rate": "%.6f"}


def log_lines(history: DataFrame) -> DataFrame:
    """(generation, csv, json): the lines of a generation log; columns that a history hasn't count as 0."""
    whole = lambda n, f: F.coalesce(F.col(n), F.lit(0)).cast("long" if f == "%d" else "double") if n in history.columns else F.lit(0 if f == "%d" else 0.0).cast("long" if f == "%d" else "double")
    values = [whole(n, f) for n, f in LOG.items()]
    json = "{" + ",".join(f'"{n}":{f}' for n, f in LOG.items()) + "}"
    return history.select("generation", F.format_string(",".join(LOG.values()), *values).alias("csv"), F.format_string(json, *values).alias("json"))


def report_text(history: DataFrame, control: Adaptive | None = None, domain: str = "", seconds: float = 0.0) -> str:
    """The report of a run: fitness, population, rates, sparkline and histogram. A history has a row a generation; only aggregates of it come to the driver."""
    r, out = report(history).first(), ["RUN REPORT", f"  Domain             : {domain or '(none)'}", f"  Elapsed            : {seconds:.3f}s"]
    out += [f"  Total generations  : {r.generations}"]
    if not r.generations:
        return "\n".join([*out, "  No generations recorded."])
    last = history.orderBy(F.desc("generation")).first().asDict()
    rate = convergence(history).orderBy(F.desc("generation")).first().convergence_rate
    out += [f"  Gen/sec            : {r.generations / seconds:.1f}"] if seconds > 0 else []
    out += [f"  Initial best       : {r.start_fitness:.6f}", f"  Final best         : {r.end_fitness:.6f}", f"  Peak best          : {r.peak_fitness:.6f}  (gen {r.peak_generation})", f"  Net improvement    : {r.end_fitness - r.start_fitness:+.6f}"]
    out += [f"  {label:<19}: {last[name]:{form}}" for label, name, form in (("Final avg fitness", "avg_fitness", ".6f"), ("Final variance", "variance", ".6f"), ("Final pop size", "population_size", "d"), ("Unique operators", "unique_operators", "d")) if name in last]
    out += [f"  Converged?         : {'YES' if converged(history).first().converged else 'no'}", f"  Convergence rate   : {rate:.8f}"]
    if control:
        out += [f"  Stall boosts       : {control.raised}", f"  Improve dampens    : {control.lowered}", f"  Final rule rate    : {control.rule:.6f}", f"  Final chrom rate   : {control.chromosome:.6f}"]
    if r.generations > 1:
        s = sparkline(history).first()
        out += [f"  {s.line}", f"  Range: [{s.least:.4f} .. {s.most:.4f}]"]
    bins = {x.bin: x.n for x in fitness_histogram(history).collect()}  # ten rows
    out += [f"  [{i / 10:.1f}-{(i + 1) / 10:.1f}) {bins.get(i, 0)}" for i in range(10)]
    return "\n".join(out)


@dataclass
class Adaptive:
    """Mutation rates that rise in stalls, fall while fitness grows fast, and drift back. The defaults are fixed values of the method."""

    base_rule: float
    base_chromosome: float
    low: float = 0.005
    high: float = 0.40
    stall: float = 0.00005
    fast: float = 0.005
    stalls: int = 30
    fasts: int = 10
    up: float = 1.20
    down: float = 0.90
    keep: float = 0.995

    def __post_init__(self):
        self.rule, self.chromosome, self.slow_run, self.fast_run, self.raised, self.lowered = self.base_rule, self.base_chromosome, 0, 0, 0, 0

    def tick(self, rate: float) -> tuple[float, float]:
        self.slow_run = self.slow_run + 1 if rate < self.stall else 0
        self.fast_run = self.fast_run + 1 if rate > self.fast else 0
        if self.slow_run >= self.stalls:
            self.rule, self.chromosome = (min(self.high, x * self.up) for x in (self.rule, self.chromosome))
            self.raised, self.slow_run = self.raised + 1, 0
        if self.fast_run >= self.fasts:
            self.rule, self.chromosome = (max(self.low, x * self.down) for x in (self.rule, self.chromosome))
            self.lowered, self.fast_run = self.lowered + 1, 0
        self.rule += (self.base_rule - self.rule) * (1 - self.keep)
        self.chromosome += (self.base_chromosome - self.chromosome) * (1 - self.keep)
        return self.rule, self.chromosome


def search(bytes_: DataFrame, config: Config = FAST, seed: int = 0, path: str | None = None, on_generation=None, seed_edges: DataFrame | None = None, control: Adaptive | None = None) -> tuple[DataFrame, list[dict]]:
    """The fittest chromosome's rules and the history. Each generation is written under path (or the checkpoint folder), which cuts its lineage. on_generation gets each
    generation's row; False from it ends the search. seed_edges: a stream's edges, of which the heaviest become the first chromosome's rules."""
    from byteloom.operators.graph import digrams

    spark = bytes_.sparkSession
    n = bytes_.count()
    if n < LEAST_CORPUS:
        raise ValueError(f"a corpus has {LEAST_CORPUS} bytes at least")
    path = path or f"{spark.conf.get('spark.checkpoint.dir', spark.conf.get('spark.sql.warehouse.dir'))}/search-{seed}-{uuid.uuid4().hex}"

    def kept(df, name):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    counted = kept(digrams(bytes_).groupBy("a", "b").agg(F.sum("freq").alias("freq")), "digrams")
    first = random_population(spark, config.population, config.first_rules, seed)
    if seed_edges is not None:
        first = first.where("chrom_id != 'c0000'").unionByName(from_edges(seed_edges, "c0000", config.first_rules))
    rules = kept(first, "generation-0")
    control, history = control or Adaptive(config.rule_mutation, config.chromosome_mutation), []
    for g in range(config.generations):
        scored = kept(fitness(rules, counted, n), f"scores-{g}")
        s = population_statistics(scored, rules).first()
        history.append({"generation": g, **s.asDict()})
        stopped = on_generation is not None and on_generation(history[-1]) is False
        window = history[-100:]
        rate = (window[-1]["best_fitness"] - window[0]["best_fitness"]) / (len(window) - 1) if len(window) > 1 else 0.0
        rule_probability, chromosome_probability = control.tick(rate)
        if stopped or g + 1 == config.generations:
            break
        children = config.population - config.elite
        slots = tournament(scored, 2 * children, config.tournament, seed * 1000 + g)
        named = lambda side: slots.where(F.col("slot") % 2 == side).select(F.col("chrom_id").alias("from_id"), F.format_string("k%04d", F.floor(F.col("slot") / 2)).alias("chrom_id")).join(rules.withColumnRenamed("chrom_id", "from_id"), "from_id").drop("from_id")  # noqa: E731, B023
        young = mutated(crossed(named(0), named(1), config.crossover, seed + g), rule_probability, config.most_rules, seed + g, chromosome_probability)
        old = rules.join(elite(scored, config.elite).select("chrom_id"), "chrom_id").withColumn("chrom_id", F.concat(F.lit("e"), F.substring("chrom_id", 2, 9), F.lit(f"g{g}")))
        rules = kept(young.unionByName(old), f"generation-{g + 1}")
    best = elite(kept(fitness(rules, counted, n), "scores-last"), 1).select("chrom_id")
    return rules.join(best, "chrom_id"), history


class Harness:
    """A search in a thread of the driver: start, pause between generations, resume, stop; and callbacks for a new best, a stall, convergence (once) and every generation."""

    def __init__(self, bytes_: DataFrame, config: Config = FAST, seed: int = 0, path: str | None = None, on_best=None, on_stall=None, on_converged=None, on_generation=None, stall: int = 50, frame: int = 500, least: float = 1e-4):
        self.bytes, self.config, self.seed, self.path = bytes_, config, seed, path
        self.on_best, self.on_stall, self.on_converged, self.on_generation, self.stall, self.frame, self.least = on_best, on_stall, on_converged, on_generation, stall, frame, least
        self.control, self.history, self.rules, self.error, self.best, self.since, self.done = Adaptive(config.rule_mutation, config.chromosome_mutation), [], None, None, float("-inf"), 0, False
        self._go, self._stop, self._thread = Event(), Event(), None
        self._go.set()

    def start(self) -> Harness:
        if self._thread:
            raise RuntimeError("it was started before")
        self._thread = Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def pause(self) -> None:
        self._go.clear()

    def resume(self) -> None:
        self._go.set()

    def stop(self) -> None:
        """Ends the search after the generation that is under way."""
        self._stop.set()
        self._go.set()

    def join(self, timeout: float | None = None) -> DataFrame | None:
        """The fittest chromosome's rules, once the search has ended; None before. An error of the search is raised here."""
        self._thread.join(timeout)
        if self.error:
            raise self.error
        return self.rules

    def _run(self) -> None:
        try:
            self.rules, _ = search(self.bytes, self.config, self.seed, self.path, self._seen, control=self.control)
        except Exception as e:  # raised in join
            self.error = e

    def _seen(self, row: dict) -> bool:
        self.history.append(row)
        call = lambda f: f and f(row)
        call(self.on_generation)
        if row["best_fitness"] > self.best:
            self.best, self.since = row["best_fitness"], 0
            call(self.on_best)
        else:
            self.since += 1
            if self.since == self.stall:
                call(self.on_stall)
        last = [r["best_fitness"] for r in self.history[-self.frame :]]
        if not self.done and len(last) == self.frame and all(y - x < self.least for x, y in zip(last, last[1:])):
            self.done = True
            call(self.on_converged)
        self._go.wait()
        return not self._stop.is_set()
