"""Regions to arrays, arrays to repeats: per-row kernels over Arrow batches, one region or array a row, so nothing is grouped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.config import ARRAYS, CLASS_ARRAYS, REPEATS, REPEATS_WITH_SEQUENCE, Config, columns
from repeatloom.functions import dna, kernels
from repeatloom.operators import extract, units

_REP = REPEATS + ", representative string"


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    fields = [p.strip().split(" ") for p in schema.split(",")]
    cols = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def split_regions(regions: DataFrame, sequences: DataFrame, pieces: DataFrame, cfg: Config) -> DataFrame:
    """The arrays of each region, in sequence coordinates. regions(seq_id, start, end) of a written table, sequences(seq_id, num_id), pieces of the same."""
    own = regions.join(sequences.select("seq_id", "num_id"), "seq_id").select(F.col("seq_id").cast("string"), F.col("num_id").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"))
    texts = extract.texts(own, pieces, "seq_id", F.col("start"), F.col("end"), "text").select("seq_id", "num_id", "start", "text")
    texts = extract.dealt(texts, regions.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for seq_id, num_id, start, text in zip(*(c.to_pylist() for c in b.columns)):
                for a, e in kernels.segment(text, cfg):
                    score, period, best, unit = kernels.describe_array(text[a - 1 : e], cfg)
                    out.append((start + a - 1, start + e - 1, seq_id, num_id, score, period, best, unit))
            yield _rows(out, ARRAYS)

    return texts.mapInArrow(run, ARRAYS)


def canonicalise(arrays: DataFrame, cfg: Config, templates: DataFrame | None = None) -> DataFrame:
    """arrays with class: the template's name where a turned representative fits one, '' elsewhere; representatives in canonical rotation."""

    @F.pandas_udf("string")
    def turn(s):
        return s.map(lambda x: kernels.canonical(x, cfg.shift_k) if x else "")

    if templates is None:
        return arrays.withColumns({"class": F.lit(""), "representative": turn("representative")})
    own = arrays.where("representative != ''").select(F.col("representative").alias("seq")).distinct().withColumn("unit_id", F.col("seq"))
    best = units.best_template(own, templates, cfg.template_gate).where(F.col("score") <= cfg.template_score)
    best = best.select(F.col("unit_id").alias("representative"), F.col("name"), "turned")
    joined = arrays.join(best, "representative", "left")
    return joined.select(*[c for c in arrays.columns if c != "representative"], F.coalesce("turned", turn("representative")).alias("representative"), F.coalesce("name", F.lit("")).alias("class")).select(*arrays.columns, "class")


def class_edges(rows: DataFrame, cfg: Config, save, block: int = 1000) -> DataFrame:
    """ra, rb, plus with ra <= rb: row rb may join a seed ra, on the strand of the stronger cover (minus where equal). rows(rank, seq).

    Rows lie in blocks by length, and blocks meet whose lengths fit. Each pair of blocks is one row of bounded work, however many
    units hold the same k-mers, and no k-mer is a row."""
    place = F.row_number().over(Window.orderBy(F.length("seq"), "rank")) - 1  # one row for each distinct unit: few
    packed = rows.withColumn("block", F.floor(place / block)).groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("rank", "seq"))).alias("rows"), F.min(F.length("seq")).alias("least"), F.max(F.length("seq")).alias("most")
    )
    packed = save(packed.select("block", "least", "most", F.col("rows.rank").alias("ranks"), F.col("rows.seq").alias("seqs")))
    a, b = (packed.select(*[F.col(c).alias(x + c) for c in packed.columns]) for x in "ab")
    meet = (F.col("bmost") >= F.floor(F.col("aleast") * (1 - cfg.class_gate))) & (F.col("bleast") <= F.ceil(F.col("amost") * (1 + cfg.class_gate)))
    pairs = save(a.select("ablock", "aleast", "amost").join(F.broadcast(b.select("bblock", "bleast", "bmost")), meet).select("ablock", "bblock"))  # a row for a thousand units
    t = pairs.join(a, "ablock").join(b, "bblock").select("aranks", "aseqs", "branks", "bseqs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(batch.num_rows):
                ra, a, rb, b = (c[x].as_py() for c in batch.columns)
                i, j, plus = kernels.cover_pairs(a, b, cfg.class_k, cfg.class_gate, cfg.class_distance)
                ra, rb = np.array(ra, np.int64)[i], np.array(rb, np.int64)[j]
                use = ra <= rb
                yield pa.RecordBatch.from_arrays([pa.array(ra[use]), pa.array(rb[use]), pa.array(plus[use])], names=["ra", "rb", "plus"])

    return extract.dealt(t, 100 * pairs.count()).mapInArrow(run, "ra long, rb long, plus boolean")


def greedy_classes(rows: DataFrame, cfg: Config, save) -> DataFrame:
    """id, class, plus. Seeds are taken by importance; each takes all later rows that may join it and that no earlier seed took.

    As sets: a row is a seed when no earlier row that could take it is a seed. In each round a row looks at the earliest such row
    that is not known to be a member: none left makes it a seed, a seed takes it, anything else waits. Rows of one text follow the
    first of them: to its seed, or to itself if it is one. rows(id, seq, importance); save(df) writes a table and reads it back,
    which ends each round's lineage."""
    order = Window.orderBy(F.col("importance").desc(), "id")
    ranked = save(rows.withColumn("rank", F.row_number().over(order).cast("long")).select("id", "seq", "rank"))  # one row for each array: few
    r = save(ranked.groupBy("seq").agg(F.min("rank").alias("rank")))
    all_edges = save(class_edges(r.select("rank", "seq"), cfg, save))
    edges = all_edges.where("ra < rb")
    state = save(r.select("rank", F.lit(None).cast("long").alias("seed"), F.lit(True).alias("plus")))
    while True:
        known = state.select(F.col("rank").alias("ra"), F.col("seed").alias("seed_of_a"))
        open_ = edges.join(known, "ra").where(F.col("seed_of_a").isNull() | (F.col("seed_of_a") == F.col("ra")))
        first = open_.groupBy(F.col("rb").alias("rank")).agg(F.min(F.struct("ra", F.col("seed_of_a").isNotNull().alias("is_seed"), "plus")).alias("m"))
        t = state.join(first, "rank", "left")
        seed = F.when(F.col("seed").isNotNull(), F.col("seed")).when(F.col("m").isNull(), F.col("rank")).when(F.col("m.is_seed"), F.col("m.ra"))
        new = save(t.select("rank", seed.alias("seed"), F.when(F.col("seed").isNull() & F.col("m.is_seed"), F.col("m.plus")).otherwise(F.col("plus")).alias("plus")))
        state = new
        if state.where("seed is null").isEmpty():
            break
    itself = all_edges.where("ra = rb").select(F.col("ra").alias("first"), F.col("plus").alias("plus_itself"))
    placed = r.join(state, "rank").withColumnRenamed("rank", "first").join(itself, "first", "left")
    plus = F.when((F.col("rank") != F.col("first")) & (F.col("first") == F.col("seed")), F.col("plus_itself")).otherwise(F.col("plus"))
    names = ranked.join(placed, "seq").select("id", "seq", "rank", "seed", plus.alias("plus"))
    number = F.row_number().over(Window.orderBy("rank"))
    seeds = names.where("rank = seed").select(F.col("seed"), F.concat_ws("_", F.length("seq").cast("string"), number.cast("string")).alias("class"), F.col("seq").alias("seed_seq"))
    return names.join(seeds, "seed").select("id", "class", "plus", "seed_seq")


def classify(arrays: DataFrame, cfg: Config, save, template_names: list[str] = ()) -> DataFrame:
    """CLASS_ARRAYS: arrays numbered by sequence and start; rows without a representative have class none_identified."""
    rows = save(arrays.withColumn("id", F.struct(F.xxhash64("seqID", "start", "end").alias("hash"), "seqID", "start", "end", "top_N")))  # arrays of two scales can have the same bounds
    todo = rows.where("representative != '' and class = ''")
    value = (F.col("end") - F.col("start")) * F.when(F.col("score") == 0, 1.0).otherwise(F.col("score"))
    found = greedy_classes(todo.select("id", F.col("representative").alias("seq"), value.alias("importance")), cfg, save)

    @F.pandas_udf("string")
    def turn(seed, member):
        return seed.combine(member, lambda s, m: kernels.align_to_seed(s, m, cfg.shift_k))

    found = found.select("id", F.col("class").alias("new"), "plus", "seed_seq")
    own = F.when(F.col("plus"), F.col("representative")).otherwise(dna.reverse_complement(F.col("representative")))
    t = rows.join(found, "id", "left")
    t = t.withColumn("representative", F.when(F.col("new").isNotNull(), turn(F.coalesce("seed_seq", F.lit("")), own)).otherwise(F.col("representative")))
    t = t.withColumn("class", F.coalesce("new", F.when(F.col("representative") == "", "none_identified").otherwise(F.col("class"))))
    return t.withColumn("array_num_ID", F.row_number().over(Window.orderBy("seqID", "start", "end", "top_N")).cast("long")).select(*columns(CLASS_ARRAYS))


def map_arrays(arrays: DataFrame, sequences: DataFrame, pieces: DataFrame, cfg: Config, templates: DataFrame | None = None) -> DataFrame:
    """REPEATS and the array's own representative: one row for each copy. Each array carries its own text and max_repeat bases on each side."""
    margin = cfg.max_repeat
    left = F.greatest(F.lit(1), F.col("start") - margin)
    t = arrays.where("representative != '' and class != 'none_identified'").join(sequences.select(F.col("seq_id").cast("string").alias("seqID"), "length"), "seqID")
    t = t.select("seqID", "array_num_ID", "start", "end", "class", "representative", "top_N", (left - 1).cast("long").alias("offset"), F.least(F.col("end") + margin, F.col("length")).alias("right"))
    t = extract.texts(t, pieces, "seqID", F.col("offset") + 1, F.col("right"), "context")
    if templates is None:
        t = t.withColumn("template", F.lit(""))
    else:
        t = t.join(templates.select(F.col("name").alias("class"), F.col("seq").alias("template")), "class", "left").withColumn("template", F.coalesce("template", F.lit("")))
    t = t.select("seqID", "array_num_ID", "start", "end", "class", "representative", "top_N", "template", "offset", "context")
    t = extract.dealt(t, arrays.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for seq_id, number, start, end, kind, unit, period, template, offset, text in zip(*(c.to_pylist() for c in b.columns)):
                r, unit = kernels.annotate_array(unit, period, text[start - 1 - offset : end - offset], start, text, offset, cfg, template)
                for i in range(len(r)):
                    out.append((seq_id, number, int(r.start[i]), int(r.end[i]), "+" if r.plus[i] else "-", float(r.score[i]), float(r.eval[i]), int(r.width[i]), kind, float(r.template[i]), unit))
            yield _rows(out, _REP)

    return t.mapInArrow(run, _REP)


def with_sequence(repeats: DataFrame, pieces: DataFrame) -> DataFrame:
    """REPEATS_WITH_SEQUENCE: each copy's text, reverse-complemented on the minus strand."""
    t = extract.texts(repeats.select(*columns(REPEATS)), pieces, "seqID", F.col("start"), F.col("end"), "text")
    return t.withColumn("sequence", F.when(F.col("strand") == "-", dna.reverse_complement(F.col("text"))).otherwise(F.col("text"))).select(*columns(REPEATS_WITH_SEQUENCE))


def class_breakdown(arrays: DataFrame, most: int = 8) -> DataFrame:
    """class, arrays, median_length of the representatives, span: the classes of the greatest span."""
    return arrays.groupBy("class").agg(F.count(F.lit(1)).alias("arrays"), F.percentile(F.length("representative"), F.lit(0.5)).alias("median_length"), F.sum(F.col("end") - F.col("start") + 1).alias("span")).orderBy(F.col("span").desc(), "class").limit(most)
