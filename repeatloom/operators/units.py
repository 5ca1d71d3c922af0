"""Comparisons of short units: similarity joins, pattern search, templates, consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.functions import dna, scan
from repeatloom.operators import period


def hamming_pairs(table: DataFrame, most: int) -> DataFrame:
    """a, b, mismatches for units of one length with at most that many mismatches. Pigeonhole: such units agree in one of
    most + 1 slices of the length, so they meet in an equi-join on (length, slice, text)."""
    parts = most + 1
    t = table.select("unit_id", "seq", F.length("seq").alias("length"))
    cuts = F.transform(
        F.sequence(F.lit(0), F.lit(most)),
        lambda i: F.struct(i.alias("slice"), F.substring("seq", F.floor(i * F.length("seq") / parts).cast("int") + 1, (F.floor((i + 1) * F.length("seq") / parts) - F.floor(i * F.length("seq") / parts)).cast("int")).alias("text")),
    )
    s = t.withColumn("s", F.explode(cuts)).select("unit_id", "seq", "length", "s.slice", "s.text")
    a, b = s.alias("a"), s.alias("b")
    met = a.join(b, (F.col("a.length") == F.col("b.length")) & (F.col("a.slice") == F.col("b.slice")) & (F.col("a.text") == F.col("b.text")) & (F.col("a.unit_id") < F.col("b.unit_id")))
    pairs = met.select(F.col("a.unit_id").alias("a"), F.col("b.unit_id").alias("b"), F.col("a.seq").alias("x"), F.col("b.seq").alias("y")).distinct()
    return pairs.select("a", "b", dna.hamming(F.col("x"), F.col("y")).cast("long").alias("mismatches")).where(F.col("mismatches") <= most)


def pattern_hits(sequences: DataFrame, pattern: str, most: int) -> DataFrame:
    """seq_id, pos, mismatches: every place where the pattern fits with at most that many mismatches; one pass over pieces of each sequence."""
    return period.each(sequences, ["pos", "mismatches"], ["long", "long"], lambda text: ([at + 1, misses] for at, misses in scan.hamming_places(text, pattern, most)))


def gated_distances(table: DataFrame, templates: DataFrame, share: float) -> DataFrame:
    """unit_id, name, distance: edit distances to the templates of fitting length. Meeting by length keeps this an equi-join."""
    t = templates.select("name", "place", F.col("seq").alias("template"), F.length("seq").alias("length"))
    low, high = F.floor(F.length("seq") * (1 - share)).cast("int"), F.ceil(F.length("seq") * (1 + share)).cast("int")
    u = table.select("unit_id", "seq", F.explode(F.sequence(low, high)).alias("length"))
    return u.join(t, "length").select("unit_id", "name", F.levenshtein("seq", "template").cast("long").alias("distance"))


def best_template(table: DataFrame, templates: DataFrame, share: float) -> DataFrame:
    """unit_id, name, rotation, score, turned: over all rotations of both strands and all templates of fitting length, the least
    edit distance over the greater length; of equals the first template (in file order, column place), then the first rotation
    (by one letter, by two, ..., the unit itself; then their reverse complements)."""
    low, high = F.floor(F.length("seq") * (1 - share)).cast("int"), F.ceil(F.length("seq") * (1 + share)).cast("int")
    t = templates.select("name", "place", F.col("seq").alias("template"), F.length("seq").alias("t_length"), F.explode(F.sequence(low, high)).alias("length"))
    u = table.select("unit_id", F.length("seq").alias("length"), F.posexplode(dna.both_strands(F.col("seq"))).alias("turn", "turned"))
    score = F.levenshtein("turned", "template") / F.greatest("length", "t_length")
    order = Window.partitionBy("unit_id").orderBy("score", "place", "rotation")
    scored = u.join(t, "length").select("unit_id", "name", "place", (F.col("turn") + 1).cast("long").alias("rotation"), score.alias("score"), "turned")
    return scored.withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i", "place")


def coverage_pairs(table: DataFrame, k: int, share: float) -> DataFrame:
    """a, b, covered: how many of a's circular k-mers occur in b, for b of fitting length. Units meet by k-mer, not in all pairs."""
    km = table.select("unit_id", F.length("seq").alias("length"), F.explode(dna.circular_kmers(F.col("seq"), k)).alias("kmer"))
    a, b = km.alias("a"), km.distinct().alias("b")
    fits = F.col("b.length").between(F.floor(F.col("a.length") * (1 - share)), F.ceil(F.col("a.length") * (1 + share)))
    return a.join(b, (F.col("a.kmer") == F.col("b.kmer")) & (F.col("a.unit_id") != F.col("b.unit_id")) & fits).groupBy(F.col("a.unit_id").alias("a"), F.col("b.unit_id").alias("b")).agg(F.count(F.lit(1)).alias("covered"))


def consensus_by(table: DataFrame, key: str) -> DataFrame:
    """key, consensus: each column's most common base among sequences of one alignment; of equals g, c, t, a in this order."""
    cells = table.select(key, F.posexplode(F.split("seq", "")).alias("col", "base")).where(F.col("base").isin(*"acgt"))
    n = cells.groupBy(key, "col", "base").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key, "col").orderBy(F.col("n").desc(), F.instr(F.lit("gcta"), F.col("base")))
    best = n.withColumn("_i", F.row_number().over(order)).where("_i = 1")
    return best.groupBy(key).agg(F.expr("listagg(base, '') within group (order by col)").alias("consensus"))
