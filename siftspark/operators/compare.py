"""One side held against another: schemas, producers and consumers, versions, contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.functions import semantic as sem
from siftspark.operators.patterns import MOST, occurring

#: So many groups of parameters that want the same go to every task; more are exchanged.
MOST_WANTED = 50_000
#: Pairs of an argument and a parameter for a task, and the most tasks that are made for them.
PAIRS, MOST_TASKS = 50_000_000, 4000


def schema_drift(schema: DataFrame, model: DataFrame) -> DataFrame:
    """schema, model: name, field. Fields that only one of the two has, for the names that both have."""
    both = schema.select("name").distinct().join(model.select("name").distinct(), "name", "left_semi")
    sides = schema.select("name", "field").distinct().withColumn("s", F.lit(1)).join(model.select("name", "field").distinct().withColumn("m", F.lit(1)), ["name", "field"], "full")
    only = F.when(F.col("m").isNull(), "schema").when(F.col("s").isNull(), "model")
    return sides.join(both, "name", "left_semi").withColumn("only_in", only).where("only_in IS NOT NULL").select("name", "field", "only_in")


def unmet_reads(produced: DataFrame, read: DataFrame) -> DataFrame:
    """produced: producer, variant, key (what each way out returns); read: producer, consumer, key. Keys read that are never produced, where all ways out agree."""
    variants = produced.groupBy("producer", "variant").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"))
    steady = variants.groupBy("producer").agg(F.count_distinct("keys").alias("n")).where("n = 1").select("producer")
    return read.select("producer", "consumer", "key").distinct().join(steady, "producer", "left_semi").join(produced.select("producer", "key").distinct(), ["producer", "key"], "left_anti")


def missing_names(used: DataFrame, declared: DataFrame) -> DataFrame:
    """used: name, path, line. First use of each name that is declared nowhere."""
    rows = used.join(declared.select("name").distinct(), "name", "left_anti")
    return rows.groupBy("name").agg(F.min_by(F.struct("path", "line"), F.struct("path", "line")).alias("at")).select("name", "at.path", "at.line")


def merged_uses(uses: DataFrame) -> DataFrame:
    """uses: name, seq, required, default_value, unit. One row a name: the strictest need, the first value that is set."""
    return uses.groupBy("name").agg(
        F.bool_or("required").alias("required"), F.min_by("default_value", F.when(F.col("default_value").isNotNull(), F.col("seq"))).alias("default_value"), F.min_by("unit", F.when(F.col("unit").isNotNull(), F.col("seq"))).alias("unit"), F.count("*").alias("uses")
    )


def both_enabled(enabled: DataFrame, contradicting: DataFrame) -> DataFrame:
    """enabled: name; contradicting: a, b. Pairs of checks that exclude each other and both run."""
    names = enabled.select("name").distinct()
    return contradicting.join(names.withColumnRenamed("name", "a"), "a", "left_semi").join(names.withColumnRenamed("name", "b"), "b", "left_semi").select("a", "b")


def first_differences(cases: DataFrame, most: int = 256) -> DataFrame:
    """cases: fn, case_no, old, new. The first of a function's first `most` cases on which its versions differ."""
    rows = cases.withColumn("nth", F.row_number().over(W.partitionBy("fn").orderBy("case_no"))).where(F.col("nth") <= most)
    differ = rows.where(~F.col("old").eqNullSafe(F.col("new")))
    return differ.groupBy("fn").agg(F.count("*").alias("differences"), F.min_by(F.struct("case_no", "old", "new"), "case_no").alias("first")).select("fn", "differences", "first.*")


def same_signature_pairs(functions: DataFrame, marks: tuple[str, ...] = ("reference", "optimized")) -> DataFrame:
    """functions: module, name, args, seq. Pairs of a plain and a fast form with equal arguments; the last of a name wins."""
    a, b = marks
    last = functions.groupBy("module", "name").agg(F.max_by("args", "seq").alias("args"))
    of = lambda m: last.where(F.endswith("name", F.lit("_" + m))).select("module", F.regexp_replace("name", f"_{m}$", "").alias("base"), F.col("args").alias(m))
    return of(a).join(of(b), ["module", "base"]).where(F.col(a).eqNullSafe(F.col(b))).select("module", "base")


def inverse_pairs(names: DataFrame, inverses: dict[str, str]) -> DataFrame:
    """names: owner, name (verb_rest). Each name with an inverse verb: the partner, null where the owner has none."""
    verbs = F.create_map(*(F.lit(x) for pair in inverses.items() for x in pair))
    rows = names.select("owner", "name").distinct()
    want = rows.withColumn("verb", F.split_part("name", F.lit("_"), F.lit(1))).withColumn("other", F.try_element_at(verbs, F.col("verb"))).where("other IS NOT NULL")
    want = want.withColumn("partner", F.concat("other", F.substring("name", F.length("verb") + 1, F.lit(1 << 20))))
    have = rows.select("owner", F.col("name").alias("partner"), F.lit(True).alias("found"))
    return want.join(have, ["owner", "partner"], "left").select("owner", "name", F.when(F.col("found"), F.col("partner")).alias("partner"))


def reconciled(results: DataFrame, provider: str, dependent: str) -> DataFrame:
    """results: name, status, note. A provider that failed leaves its dependent without evidence: say so, and error."""
    failed = results.where((F.col("name") == provider) & (F.col("status") == "ERROR")).select(F.lit(dependent).alias("name"), F.lit(True).alias("hit")).distinct()
    rows = results.join(failed, "name", "left")
    note = F.when(F.col("hit"), F.concat_ws("; ", "note", F.lit(f"{provider} failed"))).otherwise(F.col("note"))
    return rows.select("name", F.when(F.col("hit") & (F.col("status") == "PASS"), "ERROR").otherwise(F.col("status")).alias("status"), note.alias("note"))


def contract_clashes(arguments: DataFrame, contracts: DataFrame) -> DataFrame:
    """arguments: site, callee, position, unit, confidence; contracts: callee, position, unit. Values that reach a parameter of another unit."""
    wants = contracts.select("callee", "position", F.col("unit").alias("wanted"))
    return arguments.join(wants, ["callee", "position"]).where(F.col("unit").isNotNull() & (F.col("unit") != F.col("wanted"))).select("site", "callee", "position", "unit", "wanted", F.when(F.col("confidence") >= 0.9, "error").otherwise("warning").alias("severity"))


def argument_bindings(arguments: DataFrame, parameters: DataFrame) -> DataFrame:
    """arguments: site, callee, position, keyword; parameters: callee, position, name. The parameter each argument reaches: keywords by name, others by place."""
    by_place = arguments.where("keyword IS NULL").join(parameters.select("callee", "position", "name"), ["callee", "position"])
    by_name = arguments.where("keyword IS NOT NULL").join(parameters.select("callee", F.col("name").alias("keyword"), F.col("name")), ["callee", "keyword"])
    return by_place.select("site", "callee", "position", "name").unionByName(by_name.select("site", "callee", "position", "name"))


def rejected_forwards(forwards: DataFrame, passed: DataFrame, accepted: DataFrame) -> DataFrame:
    """forwards: name, terminal; passed: name, key; accepted: terminal, key. Keys that a forwarding function passes on and its terminal doesn't take."""
    keys = passed.select("name", "key").distinct().join(forwards, "name")
    known = accepted.select("terminal").distinct()
    return keys.join(known, "terminal", "left_semi").join(accepted.select("terminal", "key").distinct(), ["terminal", "key"], "left_anti").select("name", "terminal", "key")


def uncovered_pairs(pairs: DataFrame, test_calls: DataFrame) -> DataFrame:
    """pairs: a, b; test_calls: test, name. Pairs of which no one test calls both."""
    calls = test_calls.select("test", "name").distinct()
    both = pairs.join(calls.select("test", F.col("name").alias("a")), "a").join(calls.select("test", F.col("name").alias("b")), ["test", "b"])
    return pairs.join(both.select("a", "b").distinct(), ["a", "b"], "left_anti")


def untested_boundaries(calls: DataFrame, bodies: DataFrame, marker: str) -> DataFrame:
    """calls: boundary (a word); bodies: body. Boundaries that no test body with the marker names; bodies are looked up by their words."""
    words = bodies.where(F.col("body").rlike(marker)).select(F.explode(F.array_distinct(F.split("body", r"\W+"))).alias("boundary"))
    return calls.select("boundary").distinct().join(words.distinct(), "boundary", "left_anti")


def inconsistent_predicates(checks: DataFrame) -> DataFrame:
    """checks: variable, place, value. Variables that different places accept different sets of values for."""
    sets = checks.groupBy("variable", "place").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("accepted"))
    return sets.groupBy("variable").agg(F.count_distinct("accepted").alias("variants"), F.count("*").alias("places")).where("variants > 1")


def witnessed(contradictions: DataFrame, witnesses: DataFrame, least: float = 0.90) -> DataFrame:
    """contradictions: path, function, confidence; witnesses: path, function. Those with a witness are at least so sure."""
    hit = witnesses.select("path", "function").distinct().withColumn("witnessed", F.lit(True))
    rows = contradictions.join(hit, ["path", "function"], "left")
    return rows.withColumn("confidence", F.when(F.col("witnessed"), F.greatest("confidence", F.lit(least))).otherwise(F.col("confidence"))).withColumn("witnessed", F.coalesce("witnessed", F.lit(False)))


def unguarded_uses(uses: DataFrame, guards: DataFrame) -> DataFrame:
    """uses: scope, name, pos; guards: scope, name, pos. The first use of each name that may be null and that no guard comes before."""
    first = guards.groupBy("scope", "name").agg(F.min("pos").alias("guarded_at"))
    rows = uses.join(first, ["scope", "name"], "left").where(F.col("guarded_at").isNull() | (F.col("pos") < F.col("guarded_at")))
    return rows.groupBy("scope", "name").agg(F.min("pos").alias("pos"))


def semantic_clashes(arguments: DataFrame, parameters: DataFrame, most: int = MOST_WANTED, step: int = 1000, pairs: int = PAIRS) -> DataFrame:
    """arguments: site, callee, position, actual; parameters: callee, position, wanted (facts, see functions.semantic). Arguments that contradict their parameter: site, code, severity.

    Surely, or fairly surely with two sources of evidence on both sides together. Parameters that want the same are
    compared once, up to `step` of them together, and their rows repeated afterwards. Up to `most` such groups (their
    number is counted first) go to every task; more are exchanged, with the arguments, by callee and position.

    A row for each pair may be far more than is read, so pairs are counted and arguments dealt out by them: a task has
    about `pairs`, up to MOST_TASKS tasks.
    """
    place = ["callee", "position"]
    alike = parameters.groupBy(*place, "wanted").agg(F.count("*").alias("n")).withColumn("wanted_sources", sem.source_count(F.col("wanted.provenance")))
    alike = alike.withColumn("nth", F.explode(F.expr(f"sequence(0L, (n - 1) div {step})"))).withColumn("n", F.expr(f"cast(least({step}, n - {step} * nth) AS INT)")).drop("nth")
    if alike.limit(most + 1).count() <= most:
        alike = F.broadcast(alike)
        met = arguments.groupBy(*place).agg(F.count("*").cast("double").alias("a")).join(parameters.groupBy(*place).agg(F.count("*").alias("p")), place)
        tasks = int(min(MOST_TASKS, (met.agg(F.sum(F.expr("a * p"))).first()[0] or 0) / pairs))
        if tasks > arguments.sparkSession.sparkContext.defaultParallelism:
            arguments = arguments.repartition(tasks, "site", *place)
    sure = F.least("actual.confidence", "wanted.confidence")
    rows = arguments.withColumn("sources", sem.source_count(F.col("actual.provenance"))).join(alike, place)
    rows = rows.where((sure >= 0.70) | ((sure >= 0.45) & (F.col("sources") + F.col("wanted_sources") >= 2)))
    found = rows.select("site", sem.nominal_code(F.col("actual"), F.col("wanted")).alias("code"), sem.severity(sure).alias("severity"), "n")
    times = F.when(F.col("code").isNotNull(), F.col("n")).otherwise(0)  # a filter would be evaluated in the join, and the code twice
    return found.select("site", "code", "severity", F.explode(F.array_repeat(F.lit(True), times)).alias("one")).drop("one")


def sink_clashes(arguments: DataFrame, sinks: DataFrame) -> DataFrame:
    """arguments: site, callee (dotted), actual; sinks: callee, wanted. First arguments that contradict what a sink wants; sinks go by their full name or its last part."""
    short = F.element_at(F.split("callee", r"\."), -1)
    wants = sinks.select(short.alias("short"), "wanted")
    rows = arguments.withColumn("short", short).join(wants, "short").withColumn("code", sem.sink_code(F.col("actual"), F.col("wanted"))).where("code IS NOT NULL")
    sure = F.least("actual.confidence", "wanted.confidence")
    return rows.where(sem.reportable(sure, F.col("actual.provenance"))).select("site", "code", sem.severity(sure).alias("severity"))


def tagged_contradictions(values: DataFrame) -> DataFrame:
    """values: name, provenance, confidence. Contradictions that transfer rules have left in values' provenance."""
    rows = values.withColumn("code", sem.tag_code(F.col("provenance"))).where(F.col("code").isNotNull() & sem.reportable(F.col("confidence"), F.col("provenance")))
    return rows.select("name", "code", sem.severity(F.col("confidence")).alias("severity"))


def sample_cases(parameters: DataFrame, samples: DataFrame, most: int = 256) -> DataFrame:
    """parameters: fn, position, type; samples: type, nth (from 0), value. The first `most` combinations of samples for each function, in the order in which the last parameter changes fastest: fn, case_no, position, value. Functions with a parameter of a type without samples have none.

    A case's number, written with one digit for each parameter, says which sample each takes, so nothing is multiplied out that isn't used.
    """
    sizes = samples.groupBy("type").agg(F.count("*").alias("n"))
    rows = parameters.join(sizes, "type", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    after = W.partitionBy("fn").orderBy(F.desc("position")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("fn")
    capped = lambda w: F.aggregate(F.collect_list("n").over(w), F.lit(1).cast("long"), lambda x, y: F.least(x * y, F.lit(1 << 31)))
    rows = rows.withColumn("step", capped(after)).withColumn("cases", F.least(capped(whole), F.lit(most))).where("cases > 0")
    each = rows.select("fn", "position", "type", "step", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cases") - 1)).alias("case_no"))
    return each.withColumn("nth", F.expr("case_no div step % n")).join(samples, ["type", "nth"]).select("fn", "case_no", "position", "value")


def unnamed_boundaries(calls: DataFrame, bodies: DataFrame, marker: str, most: int = MOST) -> DataFrame:
    """calls: boundary; bodies: body. Boundaries whose name stands nowhere, not even inside a word, in a test body with the marker, whatever the case."""
    names = calls.select("boundary", F.lower("boundary").alias("name")).distinct()
    tests = bodies.select(F.lower("body").alias("text")).where(F.col("text").rlike(marker))
    return names.join(occurring(names.select("name"), tests, most), "name", "left_anti").select("boundary")
